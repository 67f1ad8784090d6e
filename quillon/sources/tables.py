"""Peptide tables, provenance and designs from files."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import Config, Design
from quillon.errors import ContractError, SourceError
from quillon.operators.ingest import ingest, mapped_only
from quillon.schema import CONDITION, KEY, OPTIONAL, SAMPLE, TYPES


def scan(spark: SparkSession, path: str, what: str = "table") -> DataFrame:
    """A lazy scan by the file's ending: Parquet, CSV or TSV. Delimited columns are read as text and typed later."""
    kind = PurePosixPath(str(path)).suffix.lower()
    try:
        if kind == ".parquet":
            return spark.read.parquet(str(path))
        if kind in (".csv", ".tsv", ".txt"):
            return spark.read.option("header", True).option("sep", "," if kind == ".csv" else "\t").csv(str(path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise SourceError(f"the {what} file {path} does not exist") from e
        raise SourceError(f"the {what} file {path} cannot be read: {e}") from e
    raise SourceError(f"the {what} file {path} has the unsupported ending {kind!r}; use .parquet, .csv, .tsv or .txt")


def read_peptides(spark: SparkSession, path: str, config: Config) -> DataFrame:
    """The canonical long table of a file: only mapped columns and configured samples are scanned."""
    return ingest(mapped_only(scan(spark, path, "peptide"), config.column_map), config)


def peptides_from_frame(df: DataFrame, config: Config) -> DataFrame:
    """The same from a table at hand."""
    return ingest(df, config)


def provenance_from_frame(df: DataFrame) -> DataFrame:
    """Keys and at least one of is_real, is_complete_missing and weight, typed."""
    if missing := [c for c in KEY if c not in df.columns]:
        raise ContractError(f"provenance lacks key columns: {missing}")
    if not set(OPTIONAL) & set(df.columns):
        raise ContractError(f"provenance needs one of {list(OPTIONAL)} at least")
    return df.select(*(F.col(c).cast(TYPES[c]).alias(c) if c in (*KEY, *OPTIONAL) else F.col(c) for c in df.columns))


def read_provenance(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """fmt is kept for wide files and not used."""
    return provenance_from_frame(scan(spark, path, "provenance"))


def design_from_frame(df: DataFrame) -> Design:
    """A design of one row a sample; it is small and comes to the driver."""
    if missing := [c for c in (SAMPLE, CONDITION) if c not in df.columns]:
        raise ContractError(f"the design lacks columns: {missing}")
    rows = [(r[0], r[1]) for r in df.select(F.col(SAMPLE).cast("string"), F.col(CONDITION).cast("string")).collect()]
    if not rows:
        raise ContractError("the design is empty")
    if any(not s or not c for s, c in rows):
        raise ContractError("the design has null or blank entries")
    if len({s for s, _ in rows}) < len(rows):
        raise ContractError("a sample stands in the design more than once")
    groups: dict[str, tuple[str, ...]] = {}
    for s, c in rows:
        groups[c] = (*groups.get(c, ()), s)
    return Design(tuple(s for s, _ in rows), dict(rows), groups)


def read_design(spark: SparkSession, path: str) -> Design:
    if PurePosixPath(str(path)).suffix.lower() == ".parquet":
        raise SourceError("a design is a .csv, .tsv or .txt file")
    return design_from_frame(scan(spark, path, "design"))
