"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a fixed 48-bit hash of its id and text. Tokens are summed by (source, hash bucket); the bucket in which a
source's budget ends is found by a running sum over at most 4096 buckets and only that bucket is split again, four
times in all, which resolves all 48 bits. A document is then taken by comparing its hash with its source's threshold:
nothing is sorted, thresholds are nested (a larger budget keeps all that a smaller one took) and reruns agree.

Edge cases: null text has size 0; a null source is a source of its own, ranked last; a null id hashes as the empty
string; rows that share an id are told apart by their texts, rows that share both are taken together; an empty table gives an empty result; other columns of the
input are kept out of the way, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import small, stage, word_count

#: Hash digits (base 16) resolved by one histogram, and the number of histograms.
DIGITS, LEVELS = 3, 4
BINS = 16**DIGITS
#: A source table of more rows than this is joined by shuffling; a range of sources that is summed by one task.
BROADCAST_SOURCES, RANGE_SOURCES = 100_000, 1_000_000


def _before(df: DataFrame, order: list[Column], parts: int, **sums: str) -> DataFrame:
    """df with the sums of columns over the rows before each, in order: within ranges of the order, plus the sums of the ranges before."""
    ranged = stage(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges") if parts > 1 else df.withColumn("_range", F.lit(0))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = ranged.groupBy("_range").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    totals = totals.select("_range", *(F.coalesce(F.sum(k).over(earlier), F.sum(F.col(k) * 0).over(Window.partitionBy("_range"))).alias(f"_{k}") for k in sums))
    within = ranged.select("*", *(F.coalesce(F.sum(c).over(own), F.col(c) * 0).alias(k) for k, c in sums.items()))
    joined = within.join(F.broadcast(totals), "_range")
    return joined.select(*df.columns, *((F.col(k) + F.col(f"_{k}")).alias(k) for k in sums))


def targets(sizes: DataFrame, cap: float = 3.0, cycle: int = 3, range_sources: int = RANGE_SOURCES) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights are 1..cycle, repeating over the sources by code point, null last. Targets share the sum of all sizes by
    weight; one that would exceed cap times its source's size stops there and the excess goes to the others by weight.
    Sources are filled in the order of cap * size / weight: a source is capped if what is left before it would give it more.
    """
    parts = max(1, -(-sizes.count() // range_sources))
    by_name = F.col("source").asc_nulls_last()
    ranked = _before(sizes.withColumn("one", F.lit(1).cast("long")), [by_name], parts, rank="one")
    ranked = ranked.withColumn("weight", F.col("rank") % cycle + 1).withColumn("most", (F.col("source_size") * F.lit(cap)).cast("double")).drop("one", "rank")
    filled = _before(ranked, [(F.col("most") / F.col("weight")).asc(), by_name], parts, used_size="most", used_weight="weight")
    every = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    filled = filled.withColumn("left_size", F.lit(float(every["size"])) - F.col("used_size")).withColumn("left_weight", F.lit(every["weight"]) - F.col("used_weight"))
    filled = filled.withColumn("capped", F.col("most") * F.col("left_weight") <= F.col("left_size") * F.col("weight"))
    free = filled.where(~F.col("capped")).agg(F.max("left_size").alias("size"), F.max("left_weight").alias("weight")).first()
    share = F.when(F.col("capped"), F.col("most")).otherwise(F.lit(free["size"]).cast("double") * F.col("weight") / F.lit(free["weight"]).cast("long"))
    return filled.select("source", "source_size", share.alias("target"))


def hashed(doc_id: Column, text: Column) -> Column:
    """The leading hexadecimal digits of the MD5 of id and text, as a number."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS * LEVELS), 16, 10).cast("long")


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size, h of every document, in the shared folder: the texts are read once."""
    return stage(docs.select("doc_id", "source", word_count(F.col(text)).alias("size"), hashed(F.col("doc_id"), F.col(text)).alias("h")), "sizes")


def plan(base: DataFrame, cap: float = 3.0) -> DataFrame:
    """(plan_source, source_size, target, whole_copies, threshold) from sizes(): a document is taken whole_copies times, once more if its h is below the threshold."""
    table = targets(stage(base.groupBy("source").agg(F.sum("size").alias("source_size")), "sources"), cap)
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).cast("long")
    table = stage(table.withColumn("copies", whole).withColumn("want", F.floor(F.col("target")).cast("long") - F.col("copies") * F.col("source_size")), "targets")

    cut = table.select("source", F.lit(0).cast("long").alias("prefix"), F.col("want").alias("rest"))
    for level in range(LEVELS):
        low = 16 ** (DIGITS * (LEVELS - 1 - level))
        keyed = cut.select(F.col("source").alias("cut_source"), "prefix", "rest")
        here = base.join(small(keyed, BROADCAST_SOURCES), base["source"].eqNullSafe(F.col("cut_source"))).where(F.expr(f"h div {low * BINS}") == F.col("prefix"))
        bins = here.groupBy("source", "rest", F.expr(f"h div {low}").alias("bin")).agg(F.sum("size").alias("size"))
        run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # The first bucket that the budget does not cover whole; its start is the threshold so far.
        over = bins.withColumn("upto", F.sum("size").over(run)).where(F.col("upto") > F.col("rest"))
        edge = over.groupBy("source").agg(F.min(F.struct("bin", "size", (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"))).alias("edge"))
        cut = stage(edge.select("source", F.col("edge.bin").alias("prefix"), F.col("edge.rest").alias("rest"), F.col("edge.size").alias("size")), f"cut{level}")
    # A last bucket holds documents of one hash: take it if that comes nearer to the budget.
    last = cut.select(F.col("source").alias("cut_source"), (F.col("prefix") + F.when(2 * F.col("rest") > F.col("size"), 1).otherwise(0)).alias("threshold"))
    table = table.join(small(last, BROADCAST_SOURCES), table["source"].eqNullSafe(F.col("cut_source")), "left")
    return stage(table.select(F.col("source").alias("plan_source"), "source_size", "target", F.col("copies").alias("whole_copies"), "threshold"), "plan")


def _copies(h: Column) -> Column:
    # A source without a threshold has no documents of size above 0 left beyond its budget.
    more = F.when(F.col("threshold").isNull() | (h >= F.col("threshold")), 0).otherwise(1)
    return (F.col("whole_copies") + more).cast("long")


def mix(docs: DataFrame, text: str = "text", cap: float = 3.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies. See the module for the method and edge cases."""
    base = sizes(docs, text)
    joined = base.join(small(plan(base, cap), BROADCAST_SOURCES), base["source"].eqNullSafe(F.col("plan_source")))
    copies = _copies(F.col("h"))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def apply(docs: DataFrame, text: str = "text", cap: float = 3.0) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns. The texts are not shuffled if the sources are few."""
    table = small(plan(sizes(docs, text), cap), BROADCAST_SOURCES)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    joined = docs.select(row).join(table, F.col("row.source").eqNullSafe(F.col("plan_source")))
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), _copies(hashed(F.col("row.doc_id"), F.col(f"row.`{text}`"))).cast("int")))).select("row.*")
