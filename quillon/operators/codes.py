"""Integer codes of peptides and proteins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.schema import PEPTIDE, PROTEIN

#: Ranges of proteins that are numbered apart.
RANGES = 256


def peptide_codes(df: DataFrame) -> DataFrame:
    """(protein_id, peptide_id, peptide_code): the dense rank of a peptide in its protein, from 0."""
    return df.select(PROTEIN, PEPTIDE).distinct().withColumn("peptide_code", (F.dense_rank().over(Window.partitionBy(PROTEIN).orderBy(PEPTIDE)) - 1).cast("long"))


def protein_ordinal(df: DataFrame) -> DataFrame:
    """(protein_id, protein_index), numbered over distinct proteins in sorted order without sorting them in one task.

    Proteins are dealt out by ranges; a range's first number is the count of proteins in earlier ranges, a table with a row
    a range.
    """
    ids = df.select(PROTEIN).distinct()
    every = max(1, ids.count() // RANGES)
    cuts = [r[0] for r in ids.where(F.pmod(F.xxhash64(PROTEIN), F.lit(every)) == 0).orderBy(PROTEIN).collect()]  # about RANGES names
    ranged = ids.withColumn("range", F.size(F.filter(F.array(*(F.lit(c) for c in cuts)).cast("array<string>"), lambda x: x <= F.col(PROTEIN))))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(PROTEIN)) - 1
    return ranged.withColumn("place", inside).join(F.broadcast(first), "range").select(PROTEIN, (F.col("first") + F.col("place")).cast("long").alias("protein_index"))
