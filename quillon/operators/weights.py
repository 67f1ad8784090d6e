"""Observation weights from provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.errors import ContractError
from quillon.schema import IS_MISSING, IS_REAL, KEY, OPTIONAL, WEIGHT

REAL, SPARSE = 1.0, 1e-5


def imputation_weights(is_real: Column, is_complete_missing: Column, biological_weight: float = 0.5) -> Column:
    """1 for measured values, biological_weight for values imputed in a condition that misses completely, else nearly 0."""
    if not 0 < biological_weight < 1:
        raise ContractError("the biological weight must lie between 0 and 1, both excluded")
    return F.when(is_real, REAL).when(is_complete_missing, biological_weight).otherwise(SPARSE)


def row_weights(df: DataFrame, model: str, biological_weight: float = 0.5) -> Column:
    """The weight of every row: its column, else from the masks, else 1; null for a model that finds its own."""
    if model == "rlm":
        return F.lit(None).cast("double")
    if WEIGHT in df.columns:
        return F.col(WEIGHT).cast("double")
    if {IS_REAL, IS_MISSING} <= set(df.columns):
        return imputation_weights(F.col(IS_REAL), F.col(IS_MISSING), biological_weight)
    return F.lit(1.0)


def unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of left that right lacks."""
    return left.select(*KEY).join(right.select(*KEY).distinct(), list(KEY), "left_anti")


def attach_provenance(peptides: DataFrame, provenance: DataFrame) -> DataFrame:
    """peptides with the masks and weights of provenance; columns that peptides have already win. Keys must match both ways."""
    more = [c for c in OPTIONAL if c in provenance.columns and c not in peptides.columns]
    if strange := unmatched(provenance, peptides).limit(3).collect():
        raise ContractError(f"provenance has keys that the peptide table lacks, for example {[tuple(r) for r in strange]}")
    if not provenance.isEmpty() and (bare := unmatched(peptides, provenance).limit(3).collect()):
        raise ContractError(f"the peptide table has rows without provenance, for example {[tuple(r) for r in bare]}")
    return peptides.join(provenance.select(*KEY, *more), list(KEY), "left")
