"""Checks of the data contract, folded into one aggregate."""

from __future__ import annotations

import warnings
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quillon.config import Config
from quillon.errors import ContractError, ScopeWarning
from quillon.schema import INTENSITY, IS_MISSING, IS_REAL, KEY, PEPTIDE, PROTEIN, SAMPLE, WEIGHT


def not_finite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def present_samples(df: DataFrame) -> DataFrame:
    return df.select(F.col(SAMPLE).cast("string").alias(SAMPLE)).distinct()


def scope(present: list[str], config: Config) -> dict[str, Any]:
    """Warns of samples outside the design, raises for missing ones; the metadata of the scope."""
    dropped, missing = sorted(set(present) - config.selected_sample_ids), sorted(config.selected_sample_ids - set(present))
    if dropped:
        warnings.warn(f"{len(dropped)} sample(s) are not in the design and are dropped: {dropped[:8]}{'...' if len(dropped) > 8 else ''}", ScopeWarning, stacklevel=3)
    if missing:
        raise ContractError(f"{len(missing)} configured sample(s) are missing from the peptide table: {missing[:10]}")
    return {"samples_used": config.to_design_table().sample_ids, "samples_dropped": tuple(dropped), "conditions_used": config.condition_levels}


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Keys that stand on several rows, and on how many."""
    return df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def peptides_per_protein(df: DataFrame) -> DataFrame:
    return df.groupBy(PROTEIN).agg(F.countDistinct(PEPTIDE).alias("n_peptides"))


def offenders(df: DataFrame, min_peptides: int) -> DataFrame:
    """Proteins with too few peptides."""
    return peptides_per_protein(df).where(F.col("n_peptides") < min_peptides)


def intensity_audit(df: DataFrame, log2_needed: bool = False) -> DataFrame:
    """One row: rows, non-finite, null and (before a logarithm) non-positive intensities, and the share of NaN."""
    c = F.col(INTENSITY)
    bad = F.count_if(c <= 0) if log2_needed else F.lit(0).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(not_finite(c)).alias("n_non_finite"), F.count_if(c.isNull()).alias("n_null"), bad.alias("n_non_positive"), F.coalesce(F.avg(F.when(c.isNotNull(), F.isnan(c).cast("double"))), F.lit(0.0)).alias("nan_fraction"))


def summary(df: DataFrame, config: Config) -> tuple[Row, list[Row]]:
    """What check(), scope() and the normalization look at, from one run of df, all samples included: (sums over all, one row a sample).

    Rows are summed by key and, at the same time, by sample; keys are summed by peptide, by protein and over all, while the few
    rows of samples pass through. Samples outside the design are only named.
    """
    c, log2_needed = F.col(INTENSITY), not config.input_is_log2
    inside = F.col(SAMPLE).isin(sorted(config.selected_sample_ids))
    own = lambda x: F.when(inside, x)
    rows = df.select(F.col(SAMPLE), own(F.col(PROTEIN)).alias(PROTEIN), own(F.col(PEPTIDE)).alias(PEPTIDE), inside.alias("inside"), own(c.cast("double")).alias("v"), own(F.log2(c.cast("double")) if log2_needed else c.cast("double")).alias("y"))
    control = F.col(SAMPLE).isin(list(config.conditions[config.control_condition]))
    counts = {
        "n_rows": F.count_if("inside"), "n_non_finite": F.count_if(not_finite(F.col("v"))), "n_null": F.count_if(F.col("inside") & F.col("v").isNull()),
        "n_non_positive": F.count_if(F.col("v") <= 0) if log2_needed else F.sum(F.lit(0).cast("long")), "n_nan": F.count_if(F.isnan("v")),
    }
    both = rows.groupingSets([[PROTEIN, PEPTIDE, SAMPLE], [SAMPLE]], PROTEIN, PEPTIDE, SAMPLE).agg(
        F.grouping_id().alias("by"), *(x.alias(k) for k, x in counts.items()), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.coalesce(F.count_if(control & F.col("y").isNotNull()), F.lit(0)).alias("n_control")
    )
    whole = F.col("by") == 0
    sample = F.when(~whole, F.col(SAMPLE)).alias("sample")
    step = both.where(~whole | (F.col("n_rows") > 0)).groupBy(PROTEIN, PEPTIDE, sample).agg(F.max("n_rows").alias("most"), *(F.sum(k).alias(k) for k in counts), F.max("mean").alias("mean"), F.max("std").alias("std"), F.sum("n_control").alias("n_control"))
    step = step.groupBy(PROTEIN, "sample").agg(
        F.count_if(F.col("sample").isNull()).alias("n_peptides"), F.count_if(F.col("sample").isNull() & (F.col("n_control") == 0)).alias("n_bare"), F.max("most").alias("most"), *(F.sum(k).alias(k) for k in counts), F.max("mean").alias("mean"), F.max("std").alias("std")
    )
    last = step.groupBy("sample").agg(
        *(F.sum(k).alias(k) for k in counts), F.max("most").alias("most"), F.sum("n_bare").alias("n_bare"), F.count_if(F.col("n_peptides") < config.min_peptides).alias("n_few"), F.max("mean").alias("mean"), F.max("std").alias("std")
    )
    got = last.collect()  # one row a sample, and one
    every = next((r for r in got if r["sample"] is None), None)
    return every, [r for r in got if r["sample"] is not None]


def check(df: DataFrame, config: Config, got: Row | None) -> dict[str, Any]:
    """Raises for what breaks the contract, from the sums over all; examples of rows of df are fetched only then."""
    if got is None or not got.n_rows:
        raise ContractError("no peptide rows remain for the configured samples")
    if got.most > 1:
        raise ContractError(f"peptide keys must be unique; repeated for example: {[tuple(r)[:3] for r in duplicate_keys(df).limit(3).collect()]}")
    if got.n_non_finite:
        raise ContractError(f"{INTENSITY} has {got.n_non_finite} non-finite value(s); impute them first")
    if got.n_null:
        warnings.warn(f"{INTENSITY} has {got.n_null} null value(s); imputed data are expected", ScopeWarning, stacklevel=3)
    if config.model == "wls" and WEIGHT not in df.columns and not {IS_REAL, IS_MISSING} <= set(df.columns):
        raise ContractError("model 'wls' needs a weight column, or both is_real and is_complete_missing")
    if got.n_few:
        worst = offenders(df, config.min_peptides).orderBy("n_peptides", PROTEIN).limit(5).collect()
        raise ContractError(f"{got.n_few} protein(s) have fewer than {config.min_peptides} peptides, for example {[tuple(r) for r in worst]}")
    if got.n_non_positive:
        raise ContractError(f"{INTENSITY} has {got.n_non_positive} value(s) of 0 or less, which have no logarithm; set input_is_log2 if they are logarithms")
    return {"n_rows": got.n_rows, "nan_fraction": got.n_nan / max(1, got.n_rows - got.n_null), "finite": not got.n_null and not got.n_bare}
