"""Multiple-testing correction of p-values, as plans over columns and for small vectors.

Nulls and non-finite p-values are not tested: they stay null and do not count. Within groups, the families are small and
plain windows do. Over a whole table, equal p-values are counted first, then dealt into value ranges: a range's first rank and
the extremes of the other ranges come from a table of one row a range, so no task ever sorts all p-values. Rows find their
corrected value by an equi-join on the p-value, in which the few values that very many rows share, and rows that are not
tested, do not take part: their corrected values go into the plan as literals. The rows are those of one run, in files: a
second run may add floating-point numbers in another order, and p-values that differ in their last bits would meet nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon import staging
from quillon.errors import ContractError
from quillon.functions.hommel import corrected, hommel, lower_hull, points
from quillon.functions.qvalue import LAMBDAS, pi0_from_curve

#: Distinct values that a range of a table-wide correction holds, and the most ranges: their bounds are literals of the plan.
RANGE_VALUES, RANGES = 500_000, 1024
#: A value that one row in so many has is looked up in the plan.
HEAVY = 64
VALID_METHODS = (None, "none", "bonferroni", "holm", "hommel", "hochberg", "fdr", "fdr_bh", "BY", "qvalue")
#: Methods that run from the smallest p-value up; the others run down from the largest.
UPWARD = ("holm",)


def known(method: str | None) -> str:
    if method not in VALID_METHODS:
        raise ContractError(f"unknown correction {method!r}; valid: {sorted(map(str, VALID_METHODS))}")
    return {None: "none", "fdr": "fdr_bh"}.get(method, method)


def tested(p: Column) -> Column:
    """p where it is finite, else null."""
    return F.when(~F.isnan(p) & (F.abs(p) != float("inf")), p)


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: summed for small n, else by the asymptotic series, exact to double precision."""
    series = F.log(n.cast("double")) + 0.57721566490153286061 + 1 / (2.0 * n) - 1 / (12.0 * n * n) + 1 / (120.0 * n * n * n * n)
    summed = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(n, F.lit(1000).cast("long"))), F.lit(0.0), lambda a, i: a + 1.0 / i)
    return F.when(n > 1000, series).otherwise(summed)


def _stepped(method: str, p: Column, low: Column, high: Column, m: Column, n: Column) -> Column:
    """A p-value's bound before the running extremum; low and high are the first and last rank of p-values equal to it."""
    if method == "holm":
        return F.least(F.lit(1.0), p * (n - low + 1))
    if method == "hochberg":
        return p * (n - high + 1)
    if method == "fdr_bh":
        return n / (n - m + high) * p
    if method == "BY":
        return n / (n - m + high) * harmonic(n) * p
    return p * n.cast("double") / high  # the q-value before its factor


def adjust_within(df: DataFrame, method: str | None, group: str | Sequence[str], p: str = "p_value", out: str = "adjusted") -> DataFrame:
    """df with out: p corrected within each group."""
    method = known(method)
    keys = [group] if isinstance(group, str) else list(group)
    v = tested(F.col(p))
    if method == "none":
        return df.withColumn(out, v)
    if method in ("hommel", "qvalue"):
        return _by_vector(df, method, keys, p, out)
    n = F.count(v).over(Window.partitionBy(*keys))
    if method == "bonferroni":
        return df.withColumn(out, F.when(v.isNotNull(), F.least(v * n, F.lit(1.0))))
    order = v.asc_nulls_last()
    low = F.rank().over(Window.partitionBy(*keys).orderBy(order))
    high = F.count(v).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    staged = df.withColumn("_n", n).withColumn("_low", low).withColumn("_high", high)
    staged = staged.withColumn("_b", _stepped(method, v, F.col("_low"), F.col("_high"), F.col("_n"), F.col("_n")))
    if method in UPWARD:
        run = F.max("_b").over(Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    else:
        run = F.min("_b").over(Window.partitionBy(*keys).orderBy(v.desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return staged.withColumn(out, F.when(v.isNotNull(), F.least(F.lit(1.0), run))).drop("_n", "_low", "_high", "_b")


def _by_vector(df: DataFrame, method: str, keys: list[str], p: str, out: str) -> DataFrame:
    """Group-wise correction by a kernel over each group's vector."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(table: pa.Table) -> pa.Table:
        x = np.array([np.nan if v is None else v for v in table.column(p).to_pylist()], float)
        ok = np.isfinite(x)
        y = np.full(len(x), np.nan)
        y[ok] = p_adjust(x[ok], method)
        return table.append_column(out, pa.array(y, pa.float64(), mask=~ok))

    return df.groupBy(*keys).applyInArrow(run, StructType([*df.schema.fields, StructField(out, DoubleType())]))


def distinct_values(df: DataFrame, p: str) -> DataFrame:
    """(p, c): each tested p-value once, and how often it stands."""
    return df.select(tested(F.col(p)).alias("p")).where("p is not null").groupBy("p").agg(F.count(F.lit(1)).alias("c"))


def _range_of(cuts: list[float], first: int = 0) -> Column:
    """How many of the ascending cuts are below column p, by halving them."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(F.col("p") <= cuts[half], _range_of(cuts[:half], first)).otherwise(_range_of(cuts[half + 1 :], first + half + 1))


def distinct_ranks(values: DataFrame, n_values: int) -> DataFrame:
    """(p, c, range, low, high) of n_values rows (p, c): the ranks that each p-value takes."""
    n = min(RANGES, -(-n_values // RANGE_VALUES))
    cuts = values.agg(F.percentile_approx("p", [i / n for i in range(1, n)], 10_000)).first()[0] or [] if n > 1 else []  # a row of numbers
    ranged = values.withColumn("range", _range_of(sorted(set(cuts))))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    first = ranged.groupBy("range").agg(F.sum("c").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    upto = F.sum("c").over(Window.partitionBy("range").orderBy("p"))
    return ranged.withColumn("upto", upto).join(F.broadcast(first), "range").select("p", "c", "range", (F.col("first") + F.col("upto") - F.col("c") + 1).alias("low"), (F.col("first") + F.col("upto")).alias("high"))


_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """df, kept in memory and on disk until release(): several steps look at it and it is dear to make."""
    _KEPT.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def release() -> int:
    """Let go of what results kept, in memory or in files, when no result that uses it is needed any more; the number of tables."""
    n = len(_KEPT) + staging.release()
    while _KEPT:
        _KEPT.pop().unpersist()
    return n


def _hommel_corners(ranks: DataFrame, m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hull corners of all values: each range's own corners, some cube root of its values, come to the driver and are merged."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("high")
        x, y = lower_hull(table.column("high").to_numpy(), table.column("p").to_numpy())
        return pa.table({"x": pa.array(x), "y": pa.array(y)})

    rows = sorted(map(tuple, ranks.select("range", "high", "p").groupBy("range").applyInArrow(run, "x double, y double").collect()))
    return points(np.array([y for _, y in rows]), np.array([x for x, _ in rows]), m, n)


def _looked_up(df: DataFrame, fixed: DataFrame, p: str, out: str, m: int) -> DataFrame:
    """df with out from fixed (p, c, a). Heavy and untested values meet no row of fixed and are dealt out by the partition that they come from."""
    heavy = {r.p: r.a for r in fixed.where(F.col("c") * HEAVY > m).select("p", "a").collect()}  # fewer than HEAVY rows
    light = F.when(~F.col(p).isin(list(heavy)), tested(F.col(p))) if heavy else tested(F.col(p))
    keyed = df.withColumn("_p", light).withColumn("_salt", F.when(F.col("_p").isNull(), F.spark_partition_id()).otherwise(-1))
    table = fixed.where(F.col("c") * HEAVY <= m).select(F.col("p").alias("_p"), F.lit(-1).alias("_salt"), F.col("a").alias("_a"))
    got = keyed.join(table, ["_p", "_salt"], "left")
    for value, a in heavy.items():
        got = got.withColumn("_a", F.when(F.col(p) == value, F.lit(a)).otherwise(F.col("_a")))
    return got.withColumn(out, F.col("_a")).drop("_p", "_salt", "_a").select(*df.columns, out)


def adjust(df: DataFrame, method: str | None, p: str = "p_value", out: str = "adjusted", n_tests: int | None = None) -> DataFrame:
    """df with out: p corrected over the whole table, for n_tests tests (those of the table if not given). df is run once, now."""
    method = known(method)
    v = tested(F.col(p))
    if method == "none":
        return df.withColumn(out, v)
    if method == "bonferroni":
        if n_tests is None:
            df = staging.fixed(df, "p")
        n = df.agg(F.count(v)).first()[0] if n_tests is None else n_tests
        return df.withColumn(out, F.when(v.isNotNull(), F.least(v * n, F.lit(1.0))) if n > 0 else v)
    df = staging.fixed(df, "p")  # the values and the result must have the same numbers
    values = keep(distinct_values(df, p))  # looked at several times
    size = values.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("m"), F.count(F.lit(1)).alias("d")).first()
    m = size.m
    n = m if n_tests is None else n_tests
    if n <= 0 or not m:
        return df.withColumn(out, v)
    ranks = distinct_ranks(values, size.d)
    if method == "hommel":
        x, y = _hommel_corners(ranks, m, max(m, n))
        run = F.arrow_udf(lambda c: pa.array(corrected(c.to_numpy(zero_copy_only=False), x, y, max(m, n))), "double")
        return _looked_up(df, values.select("p", "c", run("p").alias("a")), p, out, m)
    bound = _stepped(method, F.col("p"), F.col("low"), F.col("high"), F.lit(m).cast("long"), F.lit(n).cast("long"))
    ranks = ranks.withColumn("b", bound)
    if method in UPWARD:
        own = F.max("b").over(Window.partitionBy("range").orderBy("p"))
        edge = ranks.groupBy("range").agg(F.max("b").alias("e")).select("range", F.max("e").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
        run = F.greatest("own", "carry")
    else:
        own = F.min("b").over(Window.partitionBy("range").orderBy(F.desc("p")))
        edge = ranks.groupBy("range").agg(F.min("b").alias("e")).select("range", F.min("e").over(Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
        run = F.least("own", "carry")
    factor = F.lit(1.0)
    if method == "qvalue":
        factor = F.lit(pi0_of(values, m))
    fixed = ranks.withColumn("own", own).join(F.broadcast(edge), "range").select("p", "c", (factor * F.least(F.lit(1.0), run)).alias("a"))
    return _looked_up(df, fixed, p, out, m)


def lambda_curve(df: DataFrame, p: str = "p_value") -> DataFrame:
    """(lambda, n_above, pi0): p-values above each lambda and the share of true nulls they suggest; one aggregate."""
    return _curve(df, p).drop("m")


def pi0_bootstrap(df: DataFrame, p: str = "p_value") -> DataFrame:
    """(pi0) in one row: the estimate of the curve with the least mean squared error against its lower decile; 1 without p-values."""
    curve = _curve(df, p)
    met = curve.crossJoin(curve.agg(F.percentile("pi0", 0.1).alias("low")))
    spread = F.try_divide(F.col("n_above"), F.pow("m", F.lit(2)) * F.pow(1 - F.col("lambda"), F.lit(2))) * (1 - F.try_divide(F.col("n_above"), F.col("m")))
    best = F.min(F.struct((spread + F.pow(F.col("pi0") - F.col("low"), F.lit(2))).alias("error"), F.col("pi0")))
    return met.agg(best.alias("best")).select(F.least(F.lit(1.0), F.coalesce("best.pi0", F.lit(1.0))).alias("pi0"))


def _curve(df: DataFrame, p: str) -> DataFrame:
    v = tested(F.col(p))
    row = df.agg(F.count(v).alias("m"), *(F.count_if(v > x).alias(f"c{i}") for i, x in enumerate(LAMBDAS)))
    pairs = F.array(*(F.struct(F.lit(float(x)).alias("lambda"), F.col(f"c{i}").alias("n_above")) for i, x in enumerate(LAMBDAS)))
    return row.select("m", F.explode(pairs).alias("x")).select("m", "x.lambda", "x.n_above", F.try_divide(F.col("x.n_above"), F.col("m") * (1 - F.col("x.lambda"))).alias("pi0"))


def pi0_of(values: DataFrame, m: int) -> float:
    """The estimated share of true nulls among m p-values, from (p, c); the smoothing runs on the curve's 19 numbers."""
    row = values.agg(*(F.coalesce(F.sum(F.when(F.col("p") > x, F.col("c"))), F.lit(0)).alias(f"c{i}") for i, x in enumerate(LAMBDAS))).first()
    return pi0_from_curve(np.array([row[f"c{i}"] for i in range(len(LAMBDAS))], float), m)


def pi0(df: DataFrame, p: str = "p_value") -> float:
    """The estimated share of true nulls of a table."""
    values = distinct_values(df, p)
    return pi0_of(values, values.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])


def p_adjust(pvalues: Sequence[float], method: str | None, n_tests: int | None = None) -> np.ndarray:
    """Correction of a small vector of p-values."""
    p, method = np.asarray(pvalues, float), known(method)
    n = len(p) if n_tests is None else n_tests
    if n <= 0 or method == "none" or not len(p):
        return p.copy()
    if method == "bonferroni":
        return np.minimum(1.0, p * n)
    order = np.argsort(p, kind="stable")
    s, rank = p[order], np.arange(1, len(p) + 1)
    down = lambda b: np.minimum.accumulate(b[::-1])[::-1]
    if method == "hommel":
        out = hommel(s, n)
    elif method == "holm":
        out = np.maximum.accumulate(np.minimum(1.0, s * (n - rank + 1)))
    elif method == "hochberg":
        out = down(s * (n - rank + 1))
    elif method == "qvalue":
        counts = len(p) - np.searchsorted(s, LAMBDAS, side="right")
        out = pi0_from_curve(counts.astype(float), len(p)) * np.minimum(1.0, down(s * n / rank))
    else:
        out = down(n / (n - len(p) + rank) * s) * (np.sum(1.0 / np.arange(1, n + 1)) if method == "BY" else 1.0)
    result = np.empty_like(p)
    result[order] = np.minimum(1.0, out)
    return result


def p_adjust_by_group(pvalues: Sequence[float], groups: Sequence, method: str | None) -> np.ndarray:
    """Correction of a small vector within groups; non-finite values stay NaN."""
    p, groups = np.asarray(pvalues, float), np.asarray(groups)
    out = np.full(p.shape, np.nan)
    for g in np.unique(groups):
        own = np.flatnonzero((groups == g) & np.isfinite(p))
        out[own] = p_adjust(p[own], method)
    return out
