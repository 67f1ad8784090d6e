"""Token ids in binary shards with a minimal perfect hash index.

Documents are dealt out by ranges of doc_id and every task writes one shard: the ids of its documents one after another, as
unsigned 16- or 32-bit little-endian integers, then the index and a trailer. The index maps document keys to rows with a
minimal perfect hash: keys fall into buckets of about four; each bucket stores a pilot under which its keys meet no taken
slot, a bucket of one key stores its slot. A slot holds a row and a fingerprint of its key, so a key that is not in the
shard is told apart (but for one in 65,536) without reading keys; the stored keys decide the rest. Shards get their final
name only when whole, so lost and repeated tasks do no harm.

Edge cases: null and empty texts have the end id only; null ids come first and are reached by row, not by key; rows with
the same id stand next to each other and the index points at the first; ties are in order of a hash of the text, then
the text; an empty table writes no shard; texts are encoded whole.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import files
from quillon.llm.common import shared_path, stage
from quillon.llm.words import encoded

MAGIC = b"QTOKENS1"
TRAILER = struct.Struct("<8sIIQQQQQ")  # magic, id width, spare, rows, ids, keys, buckets, start of the index
END_ID = 2
#: Most words whose ids a Python process keeps, and the texts encoded at once.
CACHE, AT_ONCE = 300_000, 1000
#: Bytes of text in a shard, more or less; shards whose ranges of ids are looked up together.
SHARD_BYTES, GROUP = 64 << 20, 1024
#: Bits that remember which words were met.
SEEN = 1 << 25
DIRECT = np.uint32(1 << 31)
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (splitmix64)."""
    x = (x + _GOLD).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Encoder:
    """Texts to little-endian ids with the tokenizers library.

    If cuts_words() holds, the tokenizer lower-cases, drops white space and never joins across it, nor a comma or full stop
    behind an ASCII letter or digit with what precedes it; so a text's ids are those of its pieces cut there, whose ids are
    kept between texts. Texts that may hold a special token, which is sought before lower-casing, are not lower-cased here.
    With any other tokenizer texts are encoded whole.
    """

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.by_word = Tokenizer.from_file(path), cuts_words(path)
        #: The same vocabulary for plain lower-case words, without the patterns that texts need.
        self.light = Tokenizer.from_file(path)
        self.light.normalizer = None
        self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.known: dict[bytes, bytes] = {}
        self.seen = bytearray(SEEN >> 3)
        words = self.tokenizer.get_vocab()
        self.ends = np.array([t.endswith("</w>") for t in sorted(words, key=words.get)]) if len(words) == max(words.values()) + 1 else None

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids by word. Words of ASCII and Latin-1 letters only are encoded as one text, whose ids show where each word ends."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [i for i, t in enumerate(texts) if t.isalpha() and max(t) < "\u0100"] if self.ends is not None else []
        out: dict[bytes, bytes] = {}
        if plain:
            ids = np.array(self.light.encode_batch_fast([" ".join([texts[i].lower() for i in plain])], add_special_tokens=False)[0].ids, self.dtype)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
            if len(stops) == len(plain):
                data, starts = ids.tobytes(), [0, *stops.tolist()]
                out = {words[i]: data[a:b] for i, a, b in zip(plain, starts, starts[1:], strict=False)}
        rest = [i for i, w in enumerate(words) if w not in out]
        return out | dict(zip([words[i] for i in rest], self._encode([texts[i] for i in rest]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return [ids + self.end for ids in self._encode([t or "" for t in texts])]
        split = [pieces(t) for t in texts]
        known = self.known
        extra = self._encode_words(list(set(itertools.chain.from_iterable(split)).difference(known)))
        known.update(extra)
        get = known.__getitem__
        out = [b"".join(map(get, words)) + self.end for words in split]
        for word in self._passing(extra):
            del known[word]
        return out

    def _passing(self, words: Iterable[bytes]) -> list[bytes]:
        """Of words just learnt those not to keep: words met for the first time, so that rare ones do not fill the room, and all beyond it."""
        over, seen = [], self.seen
        room = CACHE - (len(self.known) - len(words))
        for word in words:
            h = hash(word) & SEEN - 1
            if room > 0 and seen[h >> 3] >> (h & 7) & 1:
                room -= 1
            else:
                seen[h >> 3] |= 1 << (h & 7)
                over.append(word)
        return over


#: Fixed value: the pattern of words of a tokenizer whose words never span white space nor mix letters and stops.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_words(path: str) -> bool:
    """Whether the tokenizer's own settings allow cutting texts into words: lower-casing, only words of WORD_PATTERN kept, no random merges, no special token without <|."""
    with open(path, encoding="utf-8") as file:
        settings = json.load(file)
    steps = lambda part, name: [part, *part.get(name, [])] if part else []
    normal = [(s["type"], s.get("pattern", {}).get("Regex"), s.get("content")) for s in steps(settings.get("normalizer"), "normalizers")]
    cut = [(s["type"], s.get("pattern", {}).get("Regex"), s.get("behavior"), s.get("invert"), s.get("use_regex"), s.get("add_prefix_space")) for s in steps(settings.get("pre_tokenizer"), "pretokenizers")]
    return (
        normal == [("Sequence", None, None), ("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]
        and cut == [("Sequence", None, None, None, None, None), ("Split", WORD_PATTERN, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
        and settings["model"]["type"] == "BPE" and not settings["model"].get("dropout")
        and all("<|" in t["content"] and not t["normalized"] for t in settings["added_tokens"])
    )


_STOP = re.compile(rb"(?<=[A-Za-z0-9])[.,](?=\s)")
_ENCODERS: dict[tuple, Encoder] = {}


def pieces(text: str | None) -> list[bytes]:
    """Parts of a text between which the tokenizer's words end: at ASCII white space and at a stop that it follows."""
    data = encoded(text)
    if b"<|" not in data:
        data = data.lower()
    for stop in (b", ", b". ", b".\n"):
        parts = data.split(stop)
        last = parts.pop()
        if not all([x[-1:].isalnum() for x in parts]):  # a stop stands behind something else somewhere
            return _STOP.sub(rb" \g<0>", data).split()
        parts.append(last)
        data = (b" " + stop).join(parts)
    return data.split()


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """One encoder a Python process, with the ids it has learnt, for all tasks that the process runs."""
    key = (path, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pilots, slots): slots[i] is the slot, below len(keys), of distinct keys[i]."""
    n = len(keys)
    buckets = max(1, -(-n // 4))
    h = mixed(keys.astype(np.int64).view(np.uint64))
    order = np.argsort(h % np.uint64(buckets), kind="stable")
    bounds = np.searchsorted((h % np.uint64(buckets))[order], np.arange(buckets + 1, dtype=np.uint64))
    sizes = np.diff(bounds)
    pilots, slots, taken = np.zeros(buckets, np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        size = sizes[b]
        if size < 2:
            break
        own = order[bounds[b] : bounds[b + 1]]
        first = 0
        while True:
            trial = np.arange(first, first + 64, dtype=np.uint64)
            at = (mixed(h[own][None, :] ^ mixed(trial)[:, None]) % np.uint64(n)).astype(np.int64)
            s = np.sort(at, 1)
            good = ~taken[at].any(1) & (s[:, 1:] != s[:, :-1]).all(1)
            if good.any():
                k = int(good.argmax())
                pilots[b], slots[own] = first + k, at[k]
                taken[at[k]] = True
                break
            first += 64
    single = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~taken)[: len(single)]
    pilots[single] = free.astype(np.uint32) | DIRECT
    slots[order[bounds[single]]] = free
    return pilots, slots


def find_slots(keys: np.ndarray, pilots: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, fingerprints) of keys, in constant time each."""
    h = mixed(keys.astype(np.int64).view(np.uint64))
    return slot_under(h, pilots[(h % np.uint64(len(pilots))).astype(np.int64)], n)


def slot_under(h: np.ndarray, pilot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, fingerprints) of keys with the hashes h, under the pilots of their buckets."""
    direct = (pilot & DIRECT) != 0
    hashed = mixed(h ^ mixed(pilot.astype(np.uint64))) % np.uint64(max(n, 1))
    return np.where(direct, pilot & ~DIRECT, hashed).astype(np.int64), (h >> np.uint64(48)).astype(np.uint16)


class Writer:
    """Streams one shard; only 17 bytes a document stay in memory."""

    def __init__(self, stream, dtype: np.dtype) -> None:
        self.stream, self.dtype, self.keys, self.sizes, self.null = stream, dtype, array("q"), array("q"), bytearray()

    def add(self, key: int | None, ids: bytes) -> None:
        self.stream.write(ids)
        self.keys.append(key or 0)
        self.null.append(key is None)
        self.sizes.append(len(ids) // self.dtype.itemsize)

    def close(self) -> None:
        rows = len(self.keys)
        null, keys = np.frombuffer(self.null, bool) if rows else np.zeros(0, bool), np.array(self.keys, "<i8")
        offsets = np.concatenate([[0], np.cumsum(self.sizes)]).astype("<u8")
        distinct, first = np.unique(keys[~null], return_index=True)
        first = np.flatnonzero(~null)[first]
        pilots, slots = build_index(distinct)
        row_of, print_of = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u2")
        row_of[slots] = first
        print_of[slots] = (mixed(distinct.astype(np.int64).view(np.uint64)) >> np.uint64(48)).astype(np.uint16)
        for part in (null.astype("u1"), keys, offsets, pilots.astype("<u4"), row_of, print_of):
            self.stream.write(part.tobytes())
        self.stream.write(TRAILER.pack(MAGIC, self.dtype.itemsize, 0, rows, int(offsets[-1]), len(distinct), len(pilots), int(offsets[-1]) * self.dtype.itemsize))


class Shard:
    """Keyed and sequential access to one shard by range reads. The trailer is read at once, a part of the index when it is used as a whole; get() reads single entries."""

    def __init__(self, file) -> None:
        self.file = file
        magic, self.width, _, self.rows, self.n_ids, self.n_keys, self.buckets, start = TRAILER.unpack(file.read_at(TRAILER.size, file.size() - TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.parts: dict[str, tuple[str, int, int]] = {}
        for name, kind, n in (("null", "u1", self.rows), ("keys", "<i8", self.rows), ("offsets", "<u8", self.rows + 1), ("pilots", "<u4", self.buckets), ("row_of", "<u4", self.n_keys), ("print_of", "<u2", self.n_keys)):
            self.parts[name] = (kind, n, start)
            start += n * np.dtype(kind).itemsize

    def _read(self, name: str, first: int = 0, n: int | None = None) -> np.ndarray:
        kind, size, start = self.parts[name]
        width = np.dtype(kind).itemsize
        return np.frombuffer(self.file.read_at((size if n is None else n) * width, start + first * width), kind)

    null = functools.cached_property(lambda self: self._read("null").astype(bool))
    keys = functools.cached_property(lambda self: self._read("keys"))
    offsets = functools.cached_property(lambda self: self._read("offsets"))
    pilots = functools.cached_property(lambda self: self._read("pilots"))
    row_of = functools.cached_property(lambda self: self._read("row_of"))
    print_of = functools.cached_property(lambda self: self._read("print_of"))

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, -1 where the shard has none."""
        if not self.n_keys:
            return np.full(len(keys), -1)
        slots, prints = find_slots(keys, self.pilots, self.n_keys)
        rows = self.row_of[slots].astype(np.int64)
        return np.where((self.print_of[slots] == prints) & (self.keys[rows] == keys) & ~self.null[rows], rows, -1)

    def ids(self, row: int, last: int | None = None) -> np.ndarray:
        """The ids of a row, or of rows up to last, excluded."""
        a, b = int(self.offsets[row]), int(self.offsets[row + 1 if last is None else last])
        return self._ids(a, b)

    def _ids(self, a: int, b: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a key's first row by at most six reads, whatever the shard's size; one or two where it has none, but for one key in 65,536."""
        if not self.n_keys:
            return None
        asked = np.array([key], np.int64)
        h = mixed(asked.view(np.uint64))
        pilot = self._read("pilots", int(h[0] % np.uint64(self.buckets)), 1)
        slot, fingerprint = slot_under(h, pilot, self.n_keys)
        if self._read("print_of", int(slot[0]), 1)[0] != fingerprint[0]:
            return None
        row = int(self._read("row_of", int(slot[0]), 1)[0])
        if self._read("keys", row, 1)[0] != key:
            return None
        a, b = self._read("offsets", row, 2).tolist()
        return self._ids(a, b)


def n_shards(docs: DataFrame, text: str = "text") -> int:
    """Shards in proportion to the texts, but at least one for each core."""
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))


def write(docs: DataFrame, tokenizer: str, to: str, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """Write shards of docs below the URI `to`, in order of doc_id; the table of shards: shard, uri, n_docs, n_ids, first_id, last_id (of rows with an id), start."""
    files.make_dir(to)

    def save(batches):
        used, writer, shard, manager = None, None, TaskContext.get().partitionId(), None
        uri = f"{to}/shard-{shard:06d}.ids"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                used = encoder(tokenizer, end_id)
                manager = files.written(uri)
                writer = Writer(manager.__enter__(), used.dtype)
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                for key, ids in zip(part.column(0).to_pylist(), used.encode(part.column(1).to_pylist()), strict=True):
                    writer.add(key, ids)
        if writer is not None:
            writer.close()
            manager.__exit__(None, None, None)
            named = not all(writer.null)
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "uri": [uri], "n_docs": [len(writer.keys)], "n_ids": [sum(writer.sizes)], "first_id": pa.array([writer.keys[writer.null.find(0)] if named else None], pa.int64()), "last_id": pa.array([writer.keys[-1] if named else None], pa.int64())}
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(n_shards(rows), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    shards = stage(dealt.mapInArrow(save, "shard long, uri string, n_docs long, n_ids long, first_id long, last_id long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: keys are asked for one after another and rows read where the index has them."""

    def load(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with files.opened(row["uri"]) as file:
                    shard = Shard(file)
                    bare = int(shard.null.sum())  # rows without a key come first
                    for a in range(0, shard.rows, 1000):
                        b = min(a + 1000, shard.rows)
                        null, keys = shard.null[a:b], shard.keys[a:b]
                        # A key's rows stand together from the one that the index gives; rows without a key are reached by number.
                        first, rows = bare + np.searchsorted(shard.keys[bare:], keys), np.arange(a, b)
                        at = np.where(null, rows, shard.rows_of(keys) + rows - first)
                        if (at[~null] < 0).any():
                            raise ValueError(f"{row['uri']}: the index lacks a document's key")
                        start, end = shard.offsets[at].astype(np.int64), shard.offsets[at + 1].astype(np.int64)
                        low = int(start.min())
                        ids = shard._ids(low, int(end.max())).astype("<u4")
                        crc = [zlib.crc32(ids[x - low : y - low].tobytes()) for x, y in zip(start.tolist(), end.tolist(), strict=True)]
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64(), mask=null), "start": pa.array(start + row["start"]), "n_tokens": pa.array(end - start), "ids_crc32": pa.array(crc, pa.int64())})

    n = max(1, min(4096, shards.count()))
    return shards.select("uri", "start").repartition(n).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents whose ids are asked for in keys (doc_id): each key goes to the shards in whose range it lies and is looked up there; the first row of a key counts."""

    def load(batches):
        now, file, shard = None, None, None
        for batch in batches:
            found = []
            for uri, key in zip(batch.column("uri").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                if uri != now:
                    if file is not None:
                        file.close()
                    now, file = uri, files.opened(uri)
                    shard = Shard(file)
                if (ids := shard.get(key)) is not None:
                    found.append((key, uri, ids.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found]), pa.array([x[2] for x in found], pa.list_(pa.int64()))], names=["doc_id", "uri", "ids"])

    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    table = shards.where("first_id is not null").select("uri", "first_id", "last_id", F.expr(f"shard div {GROUP}").alias("part"))
    parts = table.groupBy("part").agg(F.min("first_id").alias("low"), F.max("last_id").alias("high"))  # one row for GROUP shards
    near = asked.join(F.broadcast(parts), F.col("doc_id").between(F.col("low"), F.col("high"))).select("doc_id", "part")
    routed = near.join(table, (near["part"] == table["part"]) & F.col("doc_id").between(F.col("first_id"), F.col("last_id"))).select("uri", "doc_id")
    got = routed.repartition("uri").sortWithinPartitions("uri", "doc_id").mapInArrow(load, "doc_id long, uri string, ids array<long>")
    return got.groupBy("doc_id").agg(F.min_by("ids", "uri").alias("ids"))


def encode_table(docs: DataFrame, tokenizer: str, spark: SparkSession) -> DataFrame:
    """Write docs and read them back."""
    return read(stage(write(docs, tokenizer, shared_path(spark, "tokens")), "offsets"))
