"""One-against-the-rest tests of every peptide by weighted cell means.

The model of a peptide has an effect for each condition, for the peptide and for both together: it is saturated in the cells
(peptide or rest) x condition, so fitted values are weighted cell means and the Wald statistic of the interaction is a
weighted variance of the differences between peptide and rest across conditions. All of it is sums by cell and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.tails import f_tail
from quillon.schema import CONDITION, NORMALIZED, PEPTIDE, PROTEIN


def cells(df: DataFrame, weight: Column, value: str = NORMALIZED) -> DataFrame:
    """Sums of every (protein, peptide, condition) and of the protein's other peptides, of values centred by protein and condition.

    Rows are summed by cell where they are; only cells, a few for each peptide, meet by protein, where the sums are centred.
    """
    by = Window.partitionBy(PROTEIN, CONDITION)
    rows = df.select(PROTEIN, PEPTIDE, CONDITION, F.col(value).alias("v"), weight.cast("double").alias("w"))
    wv = F.col("w") * F.col("v")
    own = rows.groupBy(PROTEIN, PEPTIDE, CONDITION).agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("nv"), F.sum("v").alias("v"), F.sum("w").alias("w1"), F.sum(wv).alias("s1"), F.sum(wv * F.col("v")).alias("q1"))
    own = own.repartition(PROTEIN).withColumn("m", F.try_divide(F.sum("v").over(by), F.sum("nv").over(by)))
    own = own.withColumn("q1", F.col("q1") - F.col("m") * (2 * F.col("s1") - F.col("m") * F.col("w1"))).withColumn("s1", F.col("s1") - F.col("m") * F.col("w1"))
    for a, b in (("w1", "w0"), ("s1", "s0"), ("q1", "q0")):
        own = own.withColumn(b, F.sum(a).over(by) - F.col(a))
    return own.drop("v", "nv", "m").withColumn("n_peptides", F.count(F.lit(1)).over(by)).withColumn("n_all", F.sum("n").over(Window.partitionBy(PROTEIN)))


def wls_stats(parts: DataFrame, n_conditions: int) -> DataFrame:
    """Per peptide: rows of the protein, full cells, squared residuals, Wald sum, degrees of freedom."""
    full = (F.col("w1") > 0) & (F.col("w0") > 0) & (F.col("n_peptides") > 1)
    c = F.when(full, 1 / (1 / F.col("w1") + 1 / F.col("w0")))
    d = F.when(full, F.col("s1") / F.col("w1") - F.col("s0") / F.col("w0"))
    left = F.when(full, F.col("q1") - F.col("s1") * F.col("s1") / F.col("w1") + F.col("q0") - F.col("s0") * F.col("s0") / F.col("w0"))
    got = parts.withColumn("c", c).withColumn("d", d).withColumn("left", left).groupBy(PROTEIN, PEPTIDE).agg(
        F.max("n_all").alias("n_rows"), F.count("c").alias("n_cells"), F.sum("left").alias("ssr"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("d")).alias("cd"), F.sum(F.col("c") * F.col("d") * F.col("d")).alias("cdd")
    )
    return got.select(PROTEIN, PEPTIDE, "n_rows", "n_cells", "ssr", (F.col("cdd") - F.col("cd") * F.col("cd") / F.col("c")).alias("wald_sum"), (F.col("n_rows") - 2 * n_conditions).alias("df"))


def wls_pvalues(df: DataFrame, weight: Column, n_conditions: int, value: str = NORMALIZED) -> DataFrame:
    """(protein_id, peptide_id, raw_p_value, fit_status)."""
    got = wls_stats(cells(df, weight, value), n_conditions)
    j = n_conditions - 1
    status = (
        F.when(F.col("df") <= 0, "insufficient_df")
        .when(F.col("n_cells") < n_conditions, "ill_conditioned")
        .when(~(F.col("ssr") > 0), "zero_scale")
        .when(F.col("wald_sum").isNull() | F.isnan("wald_sum"), "wald_failed")
        .otherwise("ok")
    )
    got = got.withColumn("fit_status", status)
    ok = F.col("fit_status") == "ok"
    stat = F.when(ok, F.greatest(F.col("wald_sum"), F.lit(0.0)) / j / (F.col("ssr") / F.col("df")))
    p = f_tail(stat, j, F.when(ok, F.col("df").cast("double")))
    return got.select(PROTEIN, PEPTIDE, F.when(ok, p).alias("raw_p_value"), "fit_status")
