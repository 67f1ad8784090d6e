"""Benchmark decontamination by pigeonhole edit matching on words.

A test item of n words with a budget of k word edits is split into k + 1 pieces: a passage within the budget holds one of
them unchanged. Pieces are sought by rolling hashes over a whole batch of texts at once; every hit gives the place where
the item would stand, and Myers' bit-parallel edit distance decides on the words around it. Items are dealt into blocks of
bounded size by a hash and written to the shared folder by the executors; documents are scanned once, every batch of them
against all blocks, of which a Python process holds KEPT at a time. Texts are never shuffled, items never gathered.

Edge cases: null and empty texts match nothing; items of fewer than least_words words, which any text may hold by chance, are
not sought; items without an id are, and match as null; items of equal text all match; repeated rows match alike; empty tables give empty results; texts are scanned whole; other columns are carried along by clean().
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import files
from quillon.llm.common import shared_path, stage
from quillon.llm.words import folded_lower

#: Word edits allowed for each word of an item, the items of a block, more or less, and the least words of an item that is sought.
RATE, BLOCK, LEAST_WORDS = 0.2, 20_000, 5
#: Blocks whose index a Python process holds, the last used; texts that are matched at once.
KEPT, AT_ONCE = 2, 500
BASE = np.uint64(0x9E3779B97F4A7C15)
MATCHES = "array<struct<item_id bigint, distance int, start int, end int>>"
_MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def myers(masks: dict, size: int, text, most: int) -> tuple[int, int]:
    """(least distance, end) of a pattern anywhere in text; (most + 1, -1) if all exceed most.

    masks: a bit for each place of the pattern by symbol. The first end with the least distance is given.
    """
    every, high = (1 << size) - 1, 1 << size - 1
    up, down, now, best, end = every, 0, size, most + 1, -1
    for j, symbol in enumerate(text):
        eq = masks.get(symbol, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus = down | (every & ~(zero | up))
        minus = up & zero
        if plus & high:
            now += 1
        elif minus & high:
            now -= 1
        plus <<= 1
        up = (minus << 1 | (every & ~(zero | plus))) & every
        down = plus & zero & every
        if now < best:
            best, end = now, j + 1
    return best, end


@dataclass
class Index:
    """Pieces of one block of items."""

    items: list[tuple[int | None, str]]
    rate: float = RATE
    least_words: int = LEAST_WORDS
    ids: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.parts: list[tuple[int, list[int], int, dict, dict]] = []
        by_size: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item_id, text in self.items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in folded_lower(text)]
            n = len(words)
            if n < max(1, self.least_words):
                continue
            k = int(n * self.rate)
            masks: list[dict[int, int]] = [{}, {}]
            for mask, seq in zip(masks, (words, words[::-1]), strict=True):
                for i, w in enumerate(seq):
                    mask[w] = mask.get(w, 0) | 1 << i
            cuts = [n * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                key = int(rolling(np.array(words[a:b], np.uint64), b - a)[0])
                by_size.setdefault(b - a, {}).setdefault(key, []).append((len(self.parts), a))
            self.parts.append((item_id, words, k, *masks))
        self.by_size = {}
        for size, found in by_size.items():
            keys = np.array(sorted(found), np.uint64)
            some = np.zeros(1 << 16, bool)
            some[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.by_size[size] = (keys, some, [found[int(x)] for x in keys])

    def matches(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text its matched items, each at its best place."""
        get, out = self.ids.get, []
        coded = [[get(w, 0) for w in folded_lower(t)] for t in texts]
        starts = np.cumsum([0, *(len(c) + 1 for c in coded)])
        flat = np.zeros(int(starts[-1]), np.uint64)
        for a, c in zip(starts, coded, strict=False):
            flat[a : a + len(c)] = c
        places: dict[int, set[tuple[int, int]]] = {}
        for size, (keys, some, where) in self.by_size.items():
            if len(flat) < size:
                continue
            h = rolling(flat, size)
            at = np.flatnonzero(some[(h >> np.uint64(48)).astype(np.int64)])
            k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            same = keys[k] == h[at]
            for pos, key in zip(at[same].tolist(), k[same].tolist(), strict=True):
                doc = int(np.searchsorted(starts, pos, "right")) - 1
                for part, offset in where[key]:
                    places.setdefault(doc, set()).add((part, pos - int(starts[doc]) - offset))
        for doc, words in enumerate(coded):
            best: dict[int, tuple[int, int, int]] = {}
            last: dict[int, int] = {}
            for part, start in sorted(places.get(doc, ())):
                item_id, item, k, masks, back = self.parts[part]
                if part in last and start - last[part] <= 0:
                    continue
                low = max(0, start - k)
                text = words[low : start + len(item) + k]
                if words[start : start + len(item)] == item and start >= 0:
                    got = (0, start, start + len(item))
                else:
                    d, end = myers(masks, len(item), text, k)
                    if d > k:
                        continue
                    _, back_end = myers(back, len(item), text[:end][::-1], len(item))
                    got = (d, low + end - back_end, low + end)
                if part not in best or got < best[part]:
                    best[part] = got
                last[part] = start
            out.append([{"item_id": self.parts[p][0], "distance": d, "start": a, "end": b} for p, (d, a, b) in best.items()])
        return out


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` ids."""
    n = len(ids) - size + 1
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * BASE + ids[i : i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass(frozen=True)
class Blocks:
    """Where the blocks of items are, and how they are sought."""

    uri: str
    names: tuple[str, ...]
    rate: float
    least_words: int


def blocks(benchmark: DataFrame, rate: float = RATE, block: int = BLOCK, least_words: int = LEAST_WORDS) -> Blocks:
    """The items written to the shared folder in blocks of about `block` items each; only the blocks' names come to the driver."""
    uri = shared_path(benchmark.sparkSession, "items")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    n = max(1, -(-items.count() // block))
    files.make_dir(uri)

    def save(batches):
        for name, table in _by_block(batches):
            with files.written(f"{uri}/{name}") as out, pa.ipc.new_file(out, table.schema) as writer:
                writer.write_table(table)
            yield pa.RecordBatch.from_pydict({"name": [name]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")).repartition(n, "block").sortWithinPartitions("block", "item_id", "text")
    names = stage(dealt.mapInArrow(save, "name string"), "blocks")
    return Blocks(uri, tuple(sorted(r.name for r in names.collect())), rate, least_words)


def _by_block(batches):
    """(name, items) of every block, one after another."""
    now, held = None, []
    for batch in batches:
        numbers = batch.column("block").to_numpy()
        for part in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers)) + 1):
            if len(part):
                if numbers[part[0]] != now and held:
                    yield f"block-{now:06d}.arrow", pa.Table.from_batches(held)
                    held = []
                now = int(numbers[part[0]])
                held.append(batch.slice(int(part[0]), len(part)).select(["item_id", "text"]))
    if held:
        yield f"block-{now:06d}.arrow", pa.Table.from_batches(held)


_INDEXES: dict[tuple, Index] = {}


def _index(where: Blocks, name: str) -> Index:
    """A block's index, built once for as long as it is among the last KEPT that this process used."""
    key = (where, name)
    found = _INDEXES.pop(key, None)
    if found is None:
        while len(_INDEXES) >= KEPT:
            del _INDEXES[next(iter(_INDEXES))]
        with files.opened(f"{where.uri}/{name}") as file, pa.ipc.open_file(file) as reader:
            table = reader.read_all()
        found = Index(list(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist(), strict=True)), where.rate, where.least_words)
    _INDEXES[key] = found
    return found


def matcher(text: Column, where: Blocks) -> Column:
    """The matches of a text with the items of all blocks."""

    def run(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for name in where.names:
            index = _index(where, name)
            for a in range(0, len(texts), AT_ONCE):
                for k, found in enumerate(index.matches(texts[a : a + AT_ONCE].to_pylist()), a):
                    out[k] += found
        return pa.array(out, _MATCHES)

    return F.arrow_udf(run, MATCHES)(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text: str = "text", block: int = BLOCK, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, distance, start, end): every document and item that it holds, at its best place in words."""
    where = blocks(benchmark, rate, block, least_words)
    return docs.select("doc_id", F.explode(matcher(F.col(text), where)).alias("m")).select("doc_id", "m.*")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text: str = "text", block: int = BLOCK, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents that hold no item, with their columns."""
    where = blocks(benchmark, rate, block, least_words)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(row, matcher(F.col(text), where).alias("m")).where(F.size("m") == 0).select("row.*")
