"""Control-relative normalization: z-scores by sample, minus a peptide's mean z over the control samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from quillon.errors import ContractError
from quillon.schema import INTENSITY, NORMALIZED, PEPTIDE, PROTEIN, SAMPLE


def sample_stats(df: DataFrame, value: str = "y") -> DataFrame:
    """(sample_id, n, mean, std) over all rows of a sample; std of the sample, null for one row."""
    return df.groupBy(SAMPLE).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def normalize_control_relative_long(df: DataFrame, control_sample_ids: Sequence[str], input_is_log2: bool = False, intensity_col: str = INTENSITY, check: bool = True, stats: Sequence[Row] | None = None) -> DataFrame:
    """df with intensity_normalized.

    Samples are few and hold very many rows each: their statistics (sample_id, mean, std), if not given, are aggregated, with
    map-side sums; they go into the plan as a literal map. Rows shuffle once, by protein and peptide: large proteins are dealt out.
    """
    c = F.col(intensity_col).cast("double")
    logged = df.withColumn("y", c if input_is_log2 else F.log2(c))
    stats = sample_stats(logged).collect() if stats is None else stats  # one row a sample
    if check and (flat := sorted(r[SAMPLE] for r in stats if r.std == 0)):
        raise ContractError(f"samples without any spread cannot be scaled: {flat[:8]}")
    if not stats:
        return df.withColumn(NORMALIZED, F.lit(None).cast("double"))
    look = lambda k: F.create_map(*(x for r in stats for x in (F.lit(r[SAMPLE]), F.lit(r[k]).cast("double"))))[F.col(SAMPLE)]
    z = (F.col("y") - look("mean")) / F.nullif(look("std"), F.lit(0.0))
    control = F.avg(F.when(F.col(SAMPLE).isin(list(control_sample_ids)), F.col("z"))).over(Window.partitionBy(PROTEIN, PEPTIDE))
    return logged.withColumn("z", z).withColumn(NORMALIZED, F.col("z") - control).drop("y", "z")


def normalize_control_relative(wide: np.ndarray, control_column_indices: Sequence[int], input_is_log2: bool = False) -> np.ndarray:
    """The same on a small matrix of peptides by samples."""
    y = np.asarray(wide, float) if input_is_log2 else np.log2(np.asarray(wide, float))
    z = (y - y.mean(0)) / y.std(0, ddof=1)
    return z - z[:, list(control_column_indices)].mean(1, keepdims=True)
