"""From a source's columns to the canonical long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from quillon.config import ColumnMap, Config, Design
from quillon.errors import ContractError
from quillon.schema import CONDITION, INTENSITY, OPTIONAL, PROTEIN, REQUIRED, SAMPLE, TYPES


def harmonize_columns(df: DataFrame, names: ColumnMap) -> DataFrame:
    """Canonical names for source columns that are there under another name."""
    return df.withColumnsRenamed({src: dst for dst, src in names.pairs().items() if src in df.columns and src != dst})


def mapped_only(df: DataFrame, names: ColumnMap) -> DataFrame:
    """Only columns that the map names; the scan reads no others."""
    return df.select(*(c for c in dict.fromkeys(names.pairs().values()) if c in df.columns))


def representative(group: Column) -> Column:
    """One accession for a `;`-separated protein group: the first of six characters, else the first."""
    parts = F.split(group, ";")
    return F.coalesce(F.get(F.filter(parts, lambda x: F.length(x) == 6), 0), F.get(parts, 0))


def in_scope(df: DataFrame, config: Config) -> DataFrame:
    """Rows of configured samples; on the raw column, so that the filter reaches the scan."""
    return df.where(F.col(SAMPLE).isin(sorted(config.selected_sample_ids)))


def coerced(df: DataFrame) -> DataFrame:
    """Known columns cast to their types (a value that does not cast raises), protein groups resolved."""
    df = df.select(*(F.col(c).cast(TYPES[c]).alias(c) if c in TYPES else F.col(c) for c in df.columns))
    return df.withColumn(PROTEIN, representative(F.col(PROTEIN)))


def typed(df: DataFrame, config: Config) -> DataFrame:
    """Renamed and typed rows of all samples; still lazy."""
    df = harmonize_columns(df, config.column_map)
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ContractError(f"the peptide table lacks {missing}; map its columns with column_map")
    if not isinstance(df.schema[INTENSITY].dataType, NumericType | StringType):  # text, as delimited files have it, is cast
        raise ContractError(f"{INTENSITY} must be numeric, it is {df.schema[INTENSITY].dataType.simpleString()}")
    return coerced(df)


def ingest(df: DataFrame, config: Config) -> DataFrame:
    """Renamed, restricted to the design's samples and typed; still lazy."""
    return in_scope(typed(df, config), config)


def attach_conditions(df: DataFrame, design: Config | Design) -> DataFrame:
    """The condition of every row's sample, looked up in a literal map: no join. Unknown samples keep their id."""
    table = design.to_design_table() if isinstance(design, Config) else design
    pairs = [F.lit(x) for s, c in table.sample_to_condition.items() for x in (s, c)]
    return df.drop(CONDITION).withColumn(CONDITION, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(SAMPLE)), F.col(SAMPLE)))


def peptide_columns(df: DataFrame) -> DataFrame:
    """The required columns, the condition and whichever optional ones are there."""
    return df.select(*REQUIRED, CONDITION, *(c for c in OPTIONAL if c in df.columns))


def materialize_peptide_table(df: DataFrame, config: Config) -> tuple[DataFrame, tuple[str, ...]]:
    """(the ingested table, samples that it leaves out); samples are listed by one small aggregate, the table stays lazy."""
    named = harmonize_columns(df, config.column_map)
    found = {r[0] for r in named.select(F.col(SAMPLE).cast("string")).distinct().collect()}
    return ingest(named, config), tuple(sorted(found - config.selected_sample_ids))
