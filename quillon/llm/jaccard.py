"""Near-duplicate join by chosen paths: word shingles, Jaccard similarity at or above a threshold.

Texts with equal shingle sets are copies and one set stands for them. In every run a set picks those of its shingles
whose hash in that run is below a bound set by its size, about 1.25 of them; sets that pick a shared shingle meet in its
bucket. Buckets of more than LIMIT sets are split again and again, on further sampled tokens: a sketch holds the smallest
shingle of each of BINS ranges of hashes, and sets that have the same one in a range drawn for the bucket meet in its part. A
bucket of which a part keeps more than half the sets is a dense group, which no token parts: it stays whole. In a bucket all pairs are compared: first by sketch, with a bound that a pair at the threshold passes by
some eight standard deviations, then exactly on the shingles. Runs repeat until the chance to miss a pair at the
threshold is below 1 - RECALL. A pair that shares several buckets counts only in that with the smallest number, so no pair is
ever listed to drop repeats: sums of links by set and a spanning forest leave a bucket, not its pairs. Buckets too
large for one task are compared in pairs of blocks.

Edge cases: null and empty texts have no shingles, are a class of their own and have no links; texts of less than five words have
one shingle, all their words; repeated rows and equal texts are copies and link to each other; null ids count as the
largest; a set's text is found again by a hash of id and text, so rows may lack or share ids;
an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import stage
from quillon.llm.components import components
from quillon.llm.hashing import WordHashes, mix, runs
from quillon.llm.words import spaced

SIZE, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Sets in a bucket that is compared as it is, sets in a block, most splits of a larger bucket, ranges drawn for each split.
LIMIT, BLOCK, SPLITS, PLACES = 2048, 1024, 4, 2
BINS = 64
#: A pair whose sketches agree in a smaller share of bins is far below the threshold.
LEAST_AGREEMENT = 0.5


def n_runs(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold is missed with a chance below 1 - recall.

    A run picks a shared shingle with a chance of at least 1 - 1 / e; each split of a large bucket keeps the pair together
    unless its sketches differ in all ranges drawn.
    """
    found = (1 - 1 / math.e) * (1 - (1 - threshold) ** PLACES) ** SPLITS
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def shingles(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of runs of words; one for a shorter text, none for an empty one."""
    return np.unique(runs(words, min(size, len(words)))) if len(words) else np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))], "<u8").tobytes()


def sketch(s: np.ndarray) -> np.ndarray:
    """The smallest shingle of each of BINS equal ranges of hashes, in 16 bits; 0 for an empty range."""
    at = np.searchsorted(s, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
    ends = np.append(at[1:], len(s))
    low = mix(s[np.minimum(at, len(s) - 1)]) >> np.uint64(48)
    return np.where(at < ends, np.maximum(low, np.uint64(1)), 0).astype("<u2")


def path_keys(s: np.ndarray, seeds: np.ndarray, threshold: float) -> np.ndarray:
    """Bucket numbers: a hash of run and shingle for every shingle that a run picks. A run's hash is a multiplication by its odd seed."""
    bound = np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(s)))))
    h = s[None, :] * seeds[:, None]
    run, at = np.nonzero(h <= bound)
    return np.unique(mix(h[run, at] ^ seeds[run])).view(np.int64)


def row_key(text: str = "text") -> Column:
    """A hash of a row's id and text; it also tells apart rows that lack or share an id."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col(text))


def describe(docs: DataFrame, text: str = "text", size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, row_key, sid, n, sketch, keys of every document."""
    seeds = mix(np.arange(1, n_runs(threshold, recall) + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                sets = [shingles(hashes.of(spaced(t)), size) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([set_id(s) for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([sketch(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                        pa.array([path_keys(s, seeds, threshold) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "row_key", "sid", "n", "sketch", "keys"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), row_key(text).alias("row_key")).mapInArrow(run, "doc_id long, row_key long, sid binary, n int, sketch binary, keys array<long>")


def _sized(members: DataFrame) -> DataFrame:
    """Members (bucket, sid) of buckets with at least two sets, and how many: counted before they meet, so no bucket gathers."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return members.join(sizes, "bucket")


def buckets(classes: DataFrame) -> DataFrame:
    """(bucket, sid, size): first by picked shingles, then large ones split by further ones until they are small or do not part."""
    live = stage(_sized(classes.select(F.explode("keys").alias("bucket"), "sid")), "members")
    done = live.where(F.col("size") <= LIMIT)
    for level in range(SPLITS):
        live = live.where(F.col("size") > LIMIT)
        if live.isEmpty():
            return done
        place = F.pmod(F.xxhash64("bucket", "j"), F.lit(BINS))
        cut = live.join(classes.select("sid", "sketch"), "sid").select(F.col("bucket").alias("whole"), F.col("size").alias("all"), "sid", "sketch", F.explode(F.array(*(F.lit(j) for j in range(PLACES)))).alias("j"), "bucket")
        cut = stage(cut.select("whole", "all", F.xxhash64("bucket", "j", F.substring("sketch", (2 * place + 1).cast("int"), F.lit(2))).alias("bucket"), "sid"), f"split{level}")
        sizes = stage(cut.groupBy("whole", "all", "bucket").agg(F.count(F.lit(1)).alias("size")), "sizes")
        dense = sizes.groupBy("whole").agg((2 * F.max("size") > F.first("all")).alias("dense"))
        parts = sizes.join(dense, "whole").where(~F.col("dense") & (F.col("size") > 1)).select("bucket", "size")
        done = done.unionByName(live.join(dense.where("dense").select(F.col("whole").alias("bucket")), "bucket", "left_semi"))
        live = stage(cut.select("bucket", "sid").join(parts, "bucket"), "members")
        done = done.unionByName(live if level == SPLITS - 1 else live.where(F.col("size") <= LIMIT))
    return done


def _grouped(batches, keys: list[str]):
    """Tables of rows with equal keys, from batches that are sorted by them."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            c = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if held and a == 0 and all(held[-1].column(k)[0] == part.column(k)[0] for k in keys):
                held.append(part)
                continue
            if held:
                yield pa.Table.from_batches(held)
            held = [part]
    if held:
        yield pa.Table.from_batches(held)


def _shared(rows: list[np.ndarray], most: int = 1 << 22) -> np.ndarray:
    """How many values each two of the given sets have in common."""
    m = len(rows)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(m), [len(r) for r in rows])
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    code = code.reshape(-1)
    keep = count[code] > 1
    names, code = np.unique(code[keep], return_inverse=True)
    owner, code, out = owner[keep], code.reshape(-1), np.zeros((m, m), np.float32)
    step = max(1, most // m)
    for a in range(0, len(names), step):
        own = (code >= a) & (code < a + step)
        x = np.zeros((m, min(step, len(names) - a)), np.float32)
        x[owner[own], code[own] - a] = 1
        out += x @ x.T
    return out


def _comparable(bucket: int, lists: list[np.ndarray], block: np.ndarray, cross: bool) -> np.ndarray:
    """Pairs to compare here: of different blocks if cross, and without a smaller bucket in common; the upper triangle."""
    m = len(lists)
    ok = np.triu(np.ones((m, m), bool), 1)
    if cross:
        ok &= block[:, None] != block[None, :]
    if m > 1:
        earlier = [x[x < bucket] for x in lists]
        if sum(map(len, earlier)):
            ok &= _shared(earlier) == 0
    return ok


def _prune(batches):
    """The rows of a bucket that have a partner to compare, judged by sketches."""
    for table in _grouped(batches, ["bucket", "lo", "hi"]):
        m = table.num_rows
        if m < 2:
            continue
        bucket, lo, hi = (table.column(k)[0].as_py() for k in ("bucket", "lo", "hi"))
        lists = [np.array(x, np.int64) for x in table.column("buckets").to_pylist()]
        ok = _comparable(bucket, lists, table.column("block").to_numpy(), lo != hi)
        s = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u2").reshape(m, BINS)
        needed = np.zeros(m, bool)
        i, j = np.nonzero(ok)  # pairs that met in a smaller bucket are gone: few are left in most buckets
        for a in range(0, len(i), 1 << 16):
            left, right = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            x, y = s[left], s[right]
            near = ((x == y) & (x > 0)).sum(1) >= LEAST_AGREEMENT * ((x > 0) | (y > 0)).sum(1)
            needed[left[near]] = True
            needed[right[near]] = True
        yield from table.select(["bucket", "lo", "hi", "block", "sid"]).filter(pa.array(needed)).combine_chunks().to_batches()


def _verify(threshold: float):
    def run(batches):
        for table in _grouped(batches, ["bucket", "lo", "hi"]):
            table = table.take(_first_rows(table.column("sid").to_pylist()))
            m = table.num_rows
            if m < 2:
                continue
            bucket, lo, hi = (table.column(k)[0].as_py() for k in ("bucket", "lo", "hi"))
            ok = _comparable(bucket, [np.array(x, np.int64) for x in table.column("buckets").to_pylist()], table.column("block").to_numpy(), lo != hi)
            sets = [np.frombuffer(x, "<u8") for x in table.column("members").to_pylist()]
            n = np.array([len(x) for x in sets], np.float64)
            shared, weight, links = _shared(sets), table.column("weight").to_numpy().astype(np.float64), np.zeros(m, np.int64)
            for rows in (slice(a, a + 256) for a in range(0, m, 256)):
                ok[rows] &= shared[rows].astype(np.float64) * (1 + threshold) >= threshold * (n[rows, None] + n[None, :]) - 1e-6
            ok |= ok.T
            linked = ok.any(1)
            if not linked.any():
                continue
            for rows in (slice(a, a + 256) for a in range(0, m, 256)):
                links[rows] = ok[rows] @ weight
            sids = table.column("sid").to_pylist()
            root = _roots(ok)
            who = np.flatnonzero(linked)
            yield pa.RecordBatch.from_arrays([pa.array([sids[i] for i in who], pa.binary()), pa.array(links[who]), pa.array([sids[root[i]] for i in who], pa.binary())], names=["sid", "links", "peer"])

    return run


def _first_rows(sids: list[bytes]) -> list[int]:
    """Places of the first row of each set: the same text may stand under one id twice."""
    return list({s: i for i, s in reversed(list(enumerate(sids)))}.values())


def _roots(adjacent: np.ndarray) -> np.ndarray:
    """A member of each row's component that all its rows share."""
    root = np.full(len(adjacent), -1)
    for i in range(len(adjacent)):
        if root[i] < 0:
            reached = np.zeros(len(adjacent), bool)
            reached[i] = True
            front = reached
            while front.any():
                front = adjacent[front].any(0) & ~reached
                reached |= front
            root[reached] = i
    return root


def _linked(docs: DataFrame, text: str, size: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """What describe() gives, and (sid, rep, row_key, n_links, group_id, lead) of each set: its first row, its group's smallest id and first row's key."""
    described = stage(describe(docs, text, size, threshold, recall), "described")
    sets = described.where("n > 0")
    classes = sets.groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "row_key")).alias("first"), F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    classes = stage(classes.withColumn("rep", F.col("first.doc_id")).withColumn("row_key", F.col("first.row_key")), "classes")
    members = stage(buckets(classes).select("bucket", "sid", "size").distinct(), "buckets")
    lists = members.groupBy("sid").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
    own = stage(lists.join(classes.select("sid", "row_key", "weight", "sketch"), "sid"), "own")

    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    dealt = members.withColumn("blocks", F.when(F.col("size") > LIMIT, blocks).otherwise(1)).withColumn("block", F.pmod(F.xxhash64("sid", "bucket"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "sid", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    rows = dealt.join(own.select("sid", "sketch", "buckets"), "sid").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    needed = stage(rows.mapInArrow(_prune, "bucket long, lo int, hi int, block int, sid binary"), "needed")

    # Only texts that still have a partner are read again, once each, and meet in their buckets with all their shingles.
    wanted = needed.groupBy("sid").agg(F.collect_list(F.struct("bucket", "lo", "hi", "block")).alias("places")).join(own.select("sid", "row_key", "weight", "buckets"), "sid")
    texts = wanted.join(docs.select(row_key(text).alias("row_key"), F.col(text).alias("text")), "row_key")

    def expand(batches):
        hashes, seen = WordHashes(), set()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = [shingles(hashes.of(spaced(t)), size) for t in part.column("text").to_pylist()]
                good = pa.array([set_id(s) == sid and sid not in seen and not seen.add(sid) for s, sid in zip(sets, part.column("sid").to_pylist(), strict=True)], pa.bool_())
                yield part.drop_columns("text").append_column("members", pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())).filter(good)

    texts = texts.select("sid", "weight", "buckets", "places", "text").mapInArrow(expand, "sid binary, weight long, buckets array<long>, places array<struct<bucket:bigint,lo:int,hi:int,block:int>>, members binary")
    placed = texts.select("sid", "weight", "buckets", "members", F.explode("places").alias("p")).select("p.*", "sid", "weight", "buckets", "members")
    met = placed.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(_verify(threshold), "sid binary, links long, peer binary")
    met = stage(met, "links")

    links = met.groupBy("sid").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("sid").alias("a"), F.col("peer").alias("b")))
    named = roots.join(classes.select(F.col("sid").alias("node"), "first"), "node")
    named = named.join(named.groupBy("root").agg(F.min(F.struct("first.bare", "first.doc_id", "node", "first.row_key")).alias("lead")), "root").select(F.col("node").alias("sid"), "lead")
    table = classes.select("sid", "rep", "row_key", "weight").join(links, "sid", "left").join(named, "sid", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    return described, table.select("sid", "rep", "row_key", n_links, F.coalesce("lead.doc_id", "rep").alias("group_id"), F.coalesce("lead.row_key", "row_key").alias("lead"))


def join(docs: DataFrame, text: str = "text", size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, copy_id, n_shingles.

    class_id is the smallest id of the documents connected by links, n_links the number of other documents at or above the
    threshold, copies included, copy_id the smallest id among texts with the same shingles.
    """
    described, table = _linked(docs, text, size, threshold, recall)
    out = described.select("doc_id", "sid", "n").join(table.select("sid", "rep", "n_links", "group_id"), "sid", "left")
    some = F.col("n") > 0
    own = lambda c: F.when(some, F.col(c)).otherwise(F.col("doc_id"))
    return out.select("doc_id", own("group_id").alias("class_id"), F.when(some, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), own("rep").alias("copy_id"), F.col("n").cast("long").alias("n_shingles"))


def one_of_each(docs: DataFrame, text: str = "text", size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of each class, with its columns: that with the smallest id, null last, then set; rows without shingles all stay."""
    described, table = _linked(docs, text, size, threshold, recall)
    times = described.groupBy("row_key").agg(F.count(F.when(F.col("n") > 0, 1)).alias("times"))
    keep = stage(times.where("times = 0").unionByName(times.join(table.where("row_key = lead").select("row_key"), "row_key")), "keep")
    rows = docs.select(row_key(text).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    chosen = lambda many: rows.join(keep.where(F.col("times") > 1 if many else F.col("times") <= 1), F.col("key") == F.col("row_key"), "left_semi")
    kept = chosen(False).select("row")
    if not keep.where("times > 1").isEmpty():  # the same id and text in several rows
        kept = kept.unionByName(chosen(True).groupBy("key", "row.doc_id", f"row.`{text}`").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row"))
    return kept.select("row.*")
