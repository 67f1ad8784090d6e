"""Exact substring deduplication with suffix automata of reference shards.

A word goes if it lies in a window of LENGTH words that also starts in a document with a smaller id. Every document is a
reference for all later ones, so automata of all texts, streamed against all texts, would cost the square of the corpus.
An exchange of window hashes first finds which spans of which document each text has to be held against: every task
resolves the windows that repeat among its own texts, and sends each remaining window once, a 64-bit hash and its place, to
the slot that another 64-bit hash names; a passage that a third of all documents share costs one entry a task. A slot
names, for every window, the smallest document with it. Runs of windows (start, number, owner, owner's start) return to
their documents.

The owners' spans, each distinct passage about once, are the reference. They are dealt into shards of bounded size; a
shard's suffix automaton is built on words, each state with the smallest document that it occurs in, and all spans that
the exchange sent to the shard stream through it. Matching statistics of at least LENGTH words in a smaller document
report a window, and only windows that an automaton reports are removed. A window that the exchange names and no automaton
reports met another one with its hashes, which may have hidden its true owner: such windows alone go round again, with
other hashes, until none is left. A document of which a window was not reported at first is cut again by all its reports.

Edge cases: null and empty texts have no words and lose none; texts shorter than a window lose none; windows that repeat only
inside one text stay; rows that share an id are not smaller than each other and are told apart by a hash of their text;
null ids count as larger than all others; an empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import stage
from quillon.llm.hashing import WordHashes, mix, runs
from quillon.llm.words import spaced

LENGTH = 13
#: Bytes of text that a task takes at once, and that a slot of the exchange stands for; the least number of slots.
AT_ONCE, SLOT_BYTES, SLOTS = 12 << 20, 3 << 20, 128
#: Slots or shards of one task, one after another, the least number of tasks, and the most: beyond it tasks take more of them.
PER_TASK, TASKS = 4, (32, 100_000)
NULL_ID = np.iinfo(np.int64).max
#: Words whose hashes a task keeps.
KEEP_WORDS = 400_000
#: Words of a reference shard, and words that stream through one copy of it.
SHARD_WORDS, STREAM_WORDS = 60_000, 600_000
RUN = ("doc", "tag", "start", "n", "owner", "owner_tag", "owner_start")


def _packed(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _planes(a: np.ndarray) -> np.ndarray:
    """The bytes of 32-bit numbers, all first bytes first: like bytes compress better together."""
    return np.ascontiguousarray(a.astype("<u4")).view(np.uint8).reshape(-1, 4).T


def pack_runs(r: np.ndarray) -> bytes:
    """Rows of RUN, int64, in order of document and start: columns as differences, which compress well."""
    return _packed(np.array([len(r)], "<i8"), *(np.diff(r[:, k], prepend=0).astype("<i8") for k in range(r.shape[1])))


def unpack_runs(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(data), "<i8")
    return np.cumsum(flat[1:].reshape(len(RUN), int(flat[0])), axis=1).T


def merged(r: np.ndarray) -> np.ndarray:
    """Runs joined where a document's next windows have the next places of the same owner."""
    r = r[np.lexsort((r[:, 2], r[:, 1], r[:, 0]))]
    if len(r) < 2:
        return r
    follows = (r[1:, [0, 1, 4, 5]] == r[:-1, [0, 1, 4, 5]]).all(1) & (r[1:, 2] == r[:-1, 2] + r[:-1, 3]) & (r[1:, 6] == r[:-1, 6] + r[:-1, 3])
    first = np.flatnonzero(np.concatenate([[True], ~follows]))
    out = r[first].copy()
    out[:, 3] = np.add.reduceat(r[:, 3], first)
    return out


def by_slot(values: np.ndarray):
    """(slot, rows in their order) for every slot that occurs."""
    order = np.argsort(values, kind="stable")
    found, start = np.unique(values[order], return_index=True)
    return zip(found.tolist(), np.split(order, start[1:]), strict=True)


def slot_of(docs: np.ndarray, tags: np.ndarray, slots: int) -> np.ndarray:
    """The slot or shard of a row, by its id and the hash of its text: rows that share an id are dealt out too."""
    return (mix(docs.astype(np.int64).view(np.uint64) ^ mix(tags.astype(np.int64).view(np.uint64))) % np.uint64(slots)).astype(np.int64)


def tasks(pieces: int) -> int:
    return int(min(max(TASKS[0], pieces // PER_TASK), TASKS[1]))


def _emit(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["slot", "kind", "data"])


def local(doc: np.ndarray, tag: np.ndarray, words: list[np.ndarray], slots: int, length: int = LENGTH, bits: int = 64) -> list[tuple[int, int, bytes]]:
    """(slot, kind, data) of one lot of texts: kind 0 holds windows for the exchange, kind 1 runs that the lot resolves itself; hashes have so many bits."""
    order = np.lexsort((tag, doc))
    doc, tag, words = doc[order], tag[order], [words[i] for i in order]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    h, other = runs(flat, length), runs(mix(flat), length)
    of = np.repeat(np.arange(len(words)), [max(0, len(w) - length + 1) for w in words])
    at = np.arange(len(of)) - np.repeat(np.cumsum([0, *(max(0, len(w) - length + 1) for w in words[:-1])]), [max(0, len(w) - length + 1) for w in words]) if len(of) else np.zeros(0, np.int64)
    if not len(of):
        return []
    h, other = (x[offsets[of] + at] >> np.uint64(64 - bits) for x in (h, other))
    rank = np.argsort(h, kind="stable")  # equal windows in order of document and place
    hs = h[rank]
    new = np.concatenate([[True], hs[1:] != hs[:-1]])
    first = rank[np.flatnonzero(new)[np.cumsum(new) - 1]]
    owner = np.empty(len(h), np.int64)
    owner[rank] = first
    known = doc[of] > doc[of[owner]]
    out = []
    k = np.flatnonzero(known)
    if len(k):
        r = merged(np.stack([doc[of[k]], tag[of[k]], at[k], np.ones(len(k), np.int64), doc[of[owner[k]]], tag[of[owner[k]]], at[owner[k]]], 1))
        for slot, rows in by_slot(slot_of(r[:, 0], r[:, 1], slots)):
            out.append((slot, 1, pack_runs(r[rows])))
    k = np.flatnonzero(~known)
    for slot, rows in by_slot((h[k] % np.uint64(slots)).astype(np.int64)):
        own = k[rows]
        d = of[own]
        head = np.concatenate([[True], d[1:] != d[:-1]])
        start = np.flatnonzero(head)
        count = np.diff(np.append(start, len(d)))
        step = np.diff(at[own], prepend=0)
        step[start] = at[own][start]
        place = _packed(np.diff(doc[d[start]], prepend=0).astype("<i8"), tag[d[start]].astype("<i8"), _planes(count), _planes(step))
        sizes = np.array([len(own), len(start), len(place)], "<u4").tobytes()
        out.append((slot, 0, sizes + other[own].astype("<u8").tobytes() + place))
    return out


def _entries(data: bytes) -> tuple[np.ndarray, ...]:
    """(key, doc, tag, place) of one lot's windows in a slot."""
    n, docs, size = np.frombuffer(data, "<u4", 3).tolist()
    key = np.frombuffer(data, "<u8", n, 12)
    rest = zlib.decompress(data[12 + 8 * n : 12 + 8 * n + size])
    doc, tag = np.cumsum(np.frombuffer(rest, "<i8", docs)), np.frombuffer(rest, "<i8", docs, 8 * docs)
    plane = lambda size, at: np.ascontiguousarray(np.frombuffer(rest, np.uint8, 4 * size, at).reshape(4, size).T).view("<u4").reshape(-1).astype(np.int64)
    count, step = plane(docs, 16 * docs), plane(n, 20 * docs)
    total = np.cumsum(step)
    start = np.cumsum(count) - count
    place = total - np.repeat(total[start] - step[start], count)
    return key, np.repeat(doc, count), np.repeat(tag, count), place


def resolve(lots: list[bytes]) -> np.ndarray:
    """Runs of one window for every window of a slot that a smaller document has too."""
    parts = [_entries(x) for x in lots]
    key, doc, tag, place = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    shared = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    rank = shared[np.lexsort((place[shared], tag[shared], doc[shared], key[shared]))]
    if not len(rank):
        return np.zeros((0, len(RUN)), np.int64)
    new = np.concatenate([[True], key[rank][1:] != key[rank][:-1]])
    owner = rank[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = doc[rank] > doc[owner]
    a, b = rank[later], owner[later]
    return np.stack([doc[a], tag[a], place[a], np.ones(len(a), np.int64), doc[b], tag[b], place[b]], 1)


def _lots(batches, slots: int, length: int, seed: int, bits: int):
    hashes, held, size = WordHashes(KEEP_WORDS, seed), [], 0

    def flush():
        ids = np.array([NULL_ID if d is None else d for d, _, _ in held], np.int64)
        return local(ids, np.array([t for _, t, _ in held], np.int64), [hashes.of(spaced(x)) for _, _, x in held], slots, length, bits)

    for batch in batches:
        for d, t, x in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "tag", "text")), strict=True):
            held.append((d, t, x))
            size += len(x or "")
            if size >= AT_ONCE:
                if rows := flush():
                    yield _emit(rows)
                held, size = [], 0
    if held and (rows := flush()):
        yield _emit(rows)


def _slots(batches, slots: int):
    """One slot after another: its windows are resolved, and runs go on to the slots of their documents."""
    now, lots = None, []

    def done():
        r = resolve(lots)
        return [(slot, 1, pack_runs(merged(r[rows]))) for slot, rows in by_slot(slot_of(r[:, 0], r[:, 1], slots))] if len(r) else []

    for batch in batches:
        passed = []
        for slot, kind, data in zip(*(batch.column(k).to_pylist() for k in ("slot", "kind", "data")), strict=True):
            if kind == 1:
                passed.append((slot, kind, data))
                continue
            if slot != now and lots:
                passed += done()
                lots = []
            now = slot
            lots.append(data)
        if passed:
            yield _emit(passed)
    if lots and (rows := done()):
        yield _emit(rows)


def _documents(batches):
    """All runs of a slot's documents, joined: one row a document."""
    now, held = None, []

    def done():
        r = merged(np.concatenate([unpack_runs(x) for x in held]))
        head = np.flatnonzero(np.concatenate([[True], (r[1:, :2] != r[:-1, :2]).any(1)]))
        parts = np.split(r, head[1:])
        return pa.RecordBatch.from_arrays([pa.array([None if p[0, 0] == NULL_ID else int(p[0, 0]) for p in parts], pa.int64()), pa.array([int(p[0, 1]) for p in parts], pa.int64()), pa.array([pack_runs(p) for p in parts], pa.binary())], names=["doc_id", "tag", "runs"])

    for batch in batches:
        for slot, data in zip(batch.column("slot").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if slot != now and held:
                yield done()
                held = []
            now = slot
            held.append(data)
    if held:
        yield done()


def tagged(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, tag, text; the tag is a hash of the text if ids repeat, else 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    repeats = not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return rows.withColumn("tag", F.xxhash64("text") if repeats else F.lit(0).cast("long"))


def n_slots(rows: DataFrame) -> int:
    """Slots in proportion to the texts: about SLOT_BYTES of text for each."""
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(SLOTS, size // SLOT_BYTES)


def repeated_runs(rows: DataFrame, length: int = LENGTH, seed: int = 0, bits: int = 64) -> DataFrame:
    """(doc_id, tag, runs) of documents (doc_id, tag, text) that have windows whose hashes smaller documents have."""
    slots = n_slots(rows)
    parts, schema = tasks(slots), "slot long, kind int, data binary"
    sent = rows.mapInArrow(lambda it: _lots(it, slots, length, seed, bits), schema)
    met = sent.repartition(parts, "slot").sortWithinPartitions("slot").mapInArrow(lambda it: _slots(it, slots), schema)
    return met.select("slot", "data").repartition(parts, "slot").sortWithinPartitions("slot").mapInArrow(_documents, "doc_id long, tag long, runs binary")


def removed_mask(n: int, r: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of n words the windows of the runs cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, r[:, 2], 1)
    np.add.at(edge, np.minimum(r[:, 2] + r[:, 3] - 1 + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


class Automaton:
    """The suffix automaton of several texts of words; each state has the smallest document that it occurs in."""

    def __init__(self) -> None:
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.doc = [-1], [0], [NULL_ID]

    def _state(self, size: int, link: int, step: dict[bytes, int], doc: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        self.doc.append(doc)
        return len(self.size) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """The state of the words that lead from p to q, of q's words only those that short."""
        step, link, size = self.step, self.link, self.size
        if size[p] + 1 == size[q]:
            return q
        copy = self._state(size[p] + 1, link[q], dict(step[q]), NULL_ID)
        link[q] = copy
        while p >= 0 and step[p].get(word) == q:
            step[p][word] = copy
            p = link[p]
        return copy

    def add(self, words: Iterable[bytes], doc: int) -> None:
        step, link, size = self.step, self.link, self.size
        last = 0
        for word in words:
            q = step[last].get(word)
            if q is not None:  # another text went here already
                last = self._split(last, q, word)
            else:
                new, p = self._state(size[last] + 1, 0, {}, NULL_ID), last
                while p >= 0 and word not in step[p]:
                    step[p][word] = new
                    p = link[p]
                if p >= 0:
                    link[new] = self._split(p, step[p][word], word)
                last = new
            self.doc[last] = min(self.doc[last], doc)

    def finish(self) -> None:
        """Hand documents on from longer words to their endings."""
        for v in np.argsort(-np.array(self.size), kind="stable").tolist():
            if v:
                self.doc[self.link[v]] = min(self.doc[self.link[v]], self.doc[v])

    def found(self, words: list[bytes], length: int) -> list[int]:
        """For every window of the words, the smallest document with it, NULL_ID if there is none."""
        step, link, size, doc, out = self.step, self.link, self.size, self.doc, []
        v = n = 0
        for i, word in enumerate(words):
            while v and word not in step[v]:
                v = link[v]
                n = size[v]
            v = step[v].get(word, 0)
            n = n + 1 if v else 0
            if n >= length:  # of what matches, only the last window matters
                while size[link[v]] >= length:
                    v = link[v]
                n = length
            if i >= length - 1:
                out.append(doc[v] if n >= length else NULL_ID)
        return out


def _references(batches, length: int):
    """The owners' spans of a batch's runs: one row an owner, overlapping spans joined."""
    for batch in batches:
        if not batch.num_rows:
            continue
        r = np.concatenate([unpack_runs(x) for x in batch.column("runs").to_pylist()])
        r = np.unique(np.stack([r[:, 4], r[:, 5], r[:, 6], r[:, 6] + r[:, 3] - 1 + length], 1), axis=0)
        head = np.flatnonzero(np.concatenate([[True], (r[1:, :2] != r[:-1, :2]).any(1)]))
        rows = []
        for part in np.split(r, head[1:]):
            rows.append((int(part[0, 0]), int(part[0, 1]), _joined(part[:, 2:]).astype("<i4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([None if d == NULL_ID else d for d, _, _ in rows], pa.int64()), pa.array([t for _, t, _ in rows], pa.int64()), pa.array([x for _, _, x in rows], pa.binary())], names=["doc_id", "tag", "spans"])


def _joined(spans: np.ndarray) -> np.ndarray:
    """Spans (start, end) in order, with those that touch joined."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > top[:-1]]))
    return np.stack([spans[first, 0], top[np.append(first[1:] - 1, len(spans) - 1)]], 1)


_PIECES = pa.list_(pa.struct([("shard", pa.int64()), ("query", pa.bool_()), ("start", pa.int32()), ("n", pa.int32()), ("words", pa.binary())]))


def _left(words: list[bytes], mask: np.ndarray, text_out: bool):
    """The words that stay, or their digest."""
    kept = b" ".join([w for w, x in zip(words, mask.tolist(), strict=True) if not x] if mask.any() else words)
    return kept if text_out else hashlib.sha256(kept).hexdigest()


def _cut(length: int, shards: int, text_out: bool):
    """What is left of every text if all its runs are reported, and its spans for the shards: its own references, and its runs for their owners' shards."""

    def run(batches):
        for batch in (b.slice(a, 500) for b in batches for a in range(0, b.num_rows, 500)):
            kept, sizes, gone, pieces = [], [], [], []
            for doc, tag, text, data, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text", "runs", "spans")), strict=True):
                words, own = spaced(text), []
                r = np.zeros((0, len(RUN)), np.int64) if data is None else unpack_runs(data)
                mask = removed_mask(len(words), r, length) if len(r) else np.zeros(len(words), bool)
                sizes.append(len(words))
                gone.append(int(mask.sum()))
                kept.append(_left(words, mask, text_out))
                for shard, start, n in zip(slot_of(r[:, 4], r[:, 5], shards).tolist(), r[:, 2].tolist(), r[:, 3].tolist(), strict=True):
                    own.append({"shard": shard, "query": True, "start": start, "n": n, "words": b" ".join(words[start : start + n - 1 + length])})
                if spans:
                    shard = int(slot_of(np.array([doc]), np.array([tag]), shards)[0])  # an owner has an id
                    for a, b in _joined(np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2)).tolist():
                        own.append({"shard": shard, "query": False, "start": a, "n": b - a, "words": b" ".join(words[a:b])})
                pieces.append(own)
            left = pa.array(kept, pa.binary() if text_out else pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), left, pa.array(pieces, _PIECES)], names=["doc_id", "tag", "n_words", "n_removed", "kept", "pieces"])

    return run


def _report(length: int):
    """Streams each shard's spans through its automaton: (doc_id, tag, hits) with the starts of the windows that a smaller document of the shard has."""

    def run(batches):
        now, automaton = None, None
        for batch in batches:
            told = []
            for shard, copy, query, doc, tag, start, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "copy", "query", "doc_id", "tag", "start", "words")), strict=True):
                if (shard, copy) != now:
                    now, automaton, ready = (shard, copy), Automaton(), False
                if not query:
                    automaton.add(words.split(b" "), doc)
                    continue
                if not ready:
                    automaton.finish()
                    ready = True
                known = np.array(automaton.found(words.split(b" "), length), np.int64) < (NULL_ID if doc is None else doc)
                if known.any():
                    told.append((doc, tag, _pairs(start + np.flatnonzero(known))))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in told], pa.int64()), pa.array([x[1] for x in told], pa.int64()), pa.array([x[2] for x in told], pa.binary())], names=["doc_id", "tag", "hits"])

    return run


def _pairs(starts: np.ndarray) -> bytes:
    """Sorted starts of windows as (first, number) of consecutive ones."""
    first = np.flatnonzero(np.concatenate([[True], starts[1:] != starts[:-1] + 1]))
    return np.stack([starts[first], np.diff(np.append(first, len(starts)))], 1).astype("<i4").tobytes()


def _windows(pairs: list[bytes]) -> np.ndarray:
    """The sorted distinct starts behind several _pairs()."""
    p = np.frombuffer(b"".join(pairs), "<i4").reshape(-1, 2).astype(np.int64)
    return np.unique(np.repeat(p[:, 0], p[:, 1]) + np.arange(p[:, 1].sum()) - np.repeat(np.cumsum(p[:, 1]) - p[:, 1], p[:, 1]))


def _single(r: np.ndarray) -> np.ndarray:
    """Runs as runs of one window."""
    at = np.arange(r[:, 3].sum()) - np.repeat(np.cumsum(r[:, 3]) - r[:, 3], r[:, 3])
    out = np.repeat(r, r[:, 3], axis=0)
    out[:, 2] += at
    out[:, 6] += at
    out[:, 3] = 1
    return out


def _open(batches):
    """Windows of a document's runs that its hits lack: (doc_id, tag, open)."""
    for batch in batches:
        rows = []
        for doc, tag, data, hits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "runs", "hits")), strict=True):
            left = np.setdiff1d(_single(unpack_runs(data))[:, 2], _windows(hits or []))
            if len(left):
                rows.append((doc, tag, _pairs(left)))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.binary())], names=["doc_id", "tag", "open"])


def _again(batches):
    """Runs of the windows that are open only."""
    for batch in batches:
        rows = []
        for doc, tag, data, left in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "runs", "open")), strict=True):
            r = _single(unpack_runs(data))
            r = r[np.isin(r[:, 2], _windows([left]))]
            if len(r):
                rows.append((doc, tag, pack_runs(merged(r))))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.binary())], names=["doc_id", "tag", "runs"])


def _recut(length: int, text_out: bool):
    """What is left of texts whose windows at hits are removed."""

    def run(batches):
        for batch in (b.slice(a, 500) for b in batches for a in range(0, b.num_rows, 500)):
            words = [spaced(t) for t in batch.column("text").to_pylist()]
            masks = [np.zeros(len(w), bool) for w in words]
            for mask, hits in zip(masks, batch.column("hits").to_pylist(), strict=True):
                at = _windows(hits or [])
                for k in range(length):
                    mask[at + k] = True
            left = pa.array([_left(w, m, text_out) for w, m in zip(words, masks, strict=True)], pa.binary() if text_out else pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array([int(m.sum()) for m in masks], pa.int64()), left], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.tag") == F.col(f"{b}.tag"))


def _streamed(rows: DataFrame, found: DataFrame, length: int, text_out: bool, every: bool) -> tuple[DataFrame, DataFrame]:
    """(rows as they are if all windows of the runs found are reported, of every row or of those that take part; what the automata report: doc_id, tag, hits)."""
    spans = found.select("runs").mapInArrow(lambda it: _references(it, length), "doc_id long, tag long, spans binary")
    spans = stage(spans.groupBy("doc_id", "tag").agg(F.collect_list("spans").alias("spans")), "references")  # a row a task and owner at most
    total = spans.agg(F.sum(F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + F.octet_length(x)))).first()[0] or 0
    shards = int(max(32, total // 8 * 60 // SHARD_WORDS))
    both = found.alias("a").join(spans.alias("b"), _same("a", "b"), "full").select(F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), F.coalesce("a.tag", "b.tag").alias("tag"), "runs", "spans")
    joined = rows.alias("c").join(both.alias("d"), _same("c", "d"), "left" if every else "inner").select("c.doc_id", "c.tag", "text", "runs", "spans")
    pieces = "array<struct<shard:bigint,query:boolean,start:int,n:int,words:binary>>"
    cut = stage(joined.mapInArrow(_cut(length, shards, text_out), f"doc_id long, tag long, n_words long, n_removed long, kept {'binary' if text_out else 'string'}, pieces {pieces}"), "cut")

    sent = cut.select("doc_id", "tag", F.explode("pieces").alias("p")).select("doc_id", "tag", "p.*")
    load = sent.groupBy("shard").agg(F.sum(F.when(F.col("query"), F.col("n").cast("long"))).alias("load"))
    load = load.select("shard", F.greatest(F.lit(1), F.ceil(F.col("load") / STREAM_WORDS)).cast("int").alias("copies"))
    dealt = sent.join(load, "shard").withColumn("copy", F.explode(F.when(F.col("query"), F.array(F.pmod(F.xxhash64("words"), F.col("copies")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("copies") - 1))))
    dealt = dealt.repartition(tasks(shards), "shard", "copy").sortWithinPartitions("shard", "copy", "query", "doc_id")
    told = dealt.select("shard", "copy", "query", "doc_id", "tag", "start", "words").mapInArrow(_report(length), "doc_id long, tag long, hits binary")
    return cut.drop("pieces"), stage(told.groupBy("doc_id", "tag").agg(F.collect_list("hits").alias("hits")), "told")


def deduplicate(docs: DataFrame, text: str = "text", length: int = LENGTH, text_out: bool = True, bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by single spaces, UTF-8; or their SHA-256).

    bits shortens the window hashes of the exchange: results stay the same, windows go round more often.
    """
    rows = tagged(docs, text)
    cut, first, left, reports = None, None, None, []
    for seed in itertools.count():
        found = repeated_runs(rows, length, seed, bits)
        if left is not None:
            found = found.alias("a").join(left.alias("b"), _same("a", "b")).select("a.doc_id", "a.tag", "runs", "open").mapInArrow(_again, "doc_id long, tag long, runs binary")
        found = stage(found, "runs")
        texts, told = _streamed(rows, found, length, text_out, cut is None)
        cut, reports = texts if cut is None else cut, [*reports, told]
        met = found.alias("a").join(told.alias("b"), _same("a", "b"), "left").select("a.doc_id", "a.tag", "runs", "hits")
        left = stage(met.mapInArrow(_open, "doc_id long, tag long, open binary"), "open")
        if left.isEmpty():
            break
        first = left if first is None else first
    if first is None:  # every window has been reported
        return cut.drop("tag")
    hits = functools.reduce(DataFrame.unionByName, reports).alias("a").join(first.alias("b"), _same("a", "b"), "left_semi")
    hits = first.select("doc_id", "tag").alias("b").join(hits.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("hits")).alias("hits")).alias("a"), _same("a", "b"), "left").select("b.doc_id", "b.tag", "hits")
    again = rows.alias("c").join(hits.alias("d"), _same("c", "d")).select("c.doc_id", "text", "hits")
    again = again.mapInArrow(_recut(length, text_out), f"doc_id long, n_words long, n_removed long, kept {'binary' if text_out else 'string'}")
    return cut.alias("a").join(first.alias("b"), _same("a", "b"), "left_anti").drop("tag").unionByName(again)


def digests(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return deduplicate(docs, text, length, text_out=False).withColumnRenamed("kept", "kept_sha256")
