"""FASTA files as tables: records are split by Spark's text reader, fields are columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import schema
from quillon.errors import ContractError, SourceError
from quillon.functions.protein import header_fields, valid_sequence, weight_kda

COLUMNS = tuple(schema.FASTA.fieldNames())
DEFAULT_COLUMNS = tuple(c for c in COLUMNS if c not in ("organism", "taxonomyId", "proteinExistence", "sequenceVersion"))
SKIPS = ("length_filter", "malformed_header", "gene_filter", "invalid_sequence")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, piece): the parts between line ends followed by `>`; only a file's first part keeps its own `>`."""
    try:
        rows = spark.read.option("lineSep", "\n>").text(str(path))
    except AnalysisException as e:
        raise SourceError(f"the FASTA file {path} does not exist or cannot be read") from e
    return rows.select(F.input_file_name().alias("file"), F.regexp_replace(F.replace("value", F.lit("\r"), F.lit("")), "^﻿", "").alias("piece"))


def read_fasta_entries(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence): headers without `>`, sequences in upper case. Raises for empty files and for sequence before a header."""
    pieces = _pieces(spark, path)
    blank = F.trim(F.replace("piece", F.lit("\n"), F.lit(""))) == ""
    opened = F.col("piece").startswith(">")
    audit = pieces.groupBy("file").agg(F.count_if(~blank).alias("n"), F.count_if(opened | blank).alias("starts"), F.count_if(F.contains("piece", F.lit("�"))).alias("broken"))
    row = audit.agg(F.count_if(F.col("n") == 0).alias("empty"), F.count_if((F.col("n") > 0) & (F.col("starts") == 0)).alias("headless"), F.sum("broken").alias("broken"), F.count(F.lit(1)).alias("files")).first()
    if not row.files or row.empty:
        raise ContractError(f"the FASTA file {path} is empty")
    if row.headless:
        raise ContractError(f"{path} has sequence data before a header")
    if row.broken:
        raise ContractError(f"{path} is not UTF-8")
    lines = F.split(F.regexp_replace("piece", "^>", ""), "\n")
    body = F.array_join(F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.upper(F.trim(x))), "")
    return pieces.where(~blank).select(F.get(lines, 0).alias("header"), body.alias("sequence"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(entry, sequence) as written: headers without `>`, white space around lines and blank lines dropped, the case kept; an empty file gives an empty table."""
    pieces = _pieces(spark, path)
    blank = F.trim(F.replace("piece", F.lit("\n"), F.lit(""))) == ""
    audit = pieces.groupBy("file").agg(F.count_if(~blank).alias("n"), F.count_if(F.col("piece").rlike("^\\s*>") | blank).alias("starts"))
    if not audit.where("n > 0 and starts = 0").isEmpty():
        raise SourceError(f"{path} has sequence data before a header")
    records = pieces.where(~blank).select(F.explode(F.split(F.regexp_replace("piece", "^\\s*>", ""), "\n[ \t]+>")).alias("piece"))
    lines = F.transform(F.split("piece", "\n"), lambda x: F.trim(x))
    return records.select(F.get(lines, 0).alias("entry"), F.array_join(F.slice(lines, 2, F.size(lines)), "").alias("sequence"))


def annotate(entries: DataFrame, gene_only: bool = False, min_length: int = 7, max_length: int = 10**6, allow_ambiguous: bool = True) -> DataFrame:
    """entries with all columns of a protein table and skip_reason, null for those to keep. Reasons are sought in the order of SKIPS."""
    n = F.length("sequence")
    fields = header_fields(F.col("header"))
    full = entries.select("header", "sequence", *(v.alias(k) for k, v in fields.items()))
    reason = F.when((n < min_length) | (n > max_length), "length_filter").when(F.col("entry").isNull(), "malformed_header")
    if gene_only:
        reason = reason.when(F.col("geneName").isNull(), "gene_filter")
    reason = reason.when(~valid_sequence(F.col("sequence"), allow_ambiguous), "invalid_sequence")
    full = full.withColumn("skip_reason", reason).withColumn("isoformStatus", F.when(F.contains("entry", F.lit("-")), "isoform").otherwise("canonical"))
    return full.withColumn("sequenceLength", n.cast("long")).withColumn("molecularWeight_kDa", F.when(F.col("skip_reason").isNull(), weight_kda(F.col("sequence"))))


def skip_counts(annotated: DataFrame) -> DataFrame:
    """(skip_reason, n) with a row for every reason and one, null, for kept entries."""
    row = annotated.agg(*(F.count_if(F.col("skip_reason").eqNullSafe(r)).alias(r or "kept") for r in (*SKIPS, None)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(r).cast("string").alias("skip_reason"), F.col(r or "kept").alias("n")) for r in (*SKIPS, None)))).alias("x")).select("x.*")


@dataclass(frozen=True)
class FastaParseResult:
    dataframe: DataFrame
    processed: int
    skipped: dict[str, int]


def fasta_to_dataframe(
    spark: SparkSession,
    path: str,
    *,
    gene_only: bool = False,
    min_length: int = 7,
    max_length: int = 10**6,
    column_order: Sequence[str] | None = None,
    sort_by: Sequence[str] | None = None,
    sort_ascending: Sequence[bool] | None = None,
    allow_ambiguous: bool = True,
    include_sequence: bool = True,
    return_result: bool = False,
) -> DataFrame | FastaParseResult:
    """The protein table of a UniProt FASTA file, sorted; with return_result, also what was skipped and why."""
    columns = [c for c in (column_order if column_order is not None else DEFAULT_COLUMNS) if include_sequence or c != "sequence"]
    keys = list(sort_by or ["entry", "isoformStatus"])
    if unknown := [c for c in (*columns, *keys) if c not in COLUMNS]:
        raise ContractError(f"unknown columns {unknown}; choose from {list(COLUMNS)}")
    up = list(sort_ascending or [True, False])
    rows = annotate(read_fasta_entries(spark, path), gene_only, min_length, max_length, allow_ambiguous)
    table = rows.where("skip_reason is null").orderBy(*keys, ascending=[up[i] if i < len(up) else True for i in range(len(keys))]).select(*columns)
    if not return_result:
        return table
    counts = {r.skip_reason: r.n for r in skip_counts(rows).collect()}
    return FastaParseResult(table, counts.pop(None), counts)
