"""Clusters of a protein's peptides by their condition profiles."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.config import Config
from quillon.operators.ward import cluster_profiles
from quillon.schema import CONDITION, NORMALIZED, PEPTIDE, PROTEIN


def condition_medians(df: DataFrame, value: str = NORMALIZED) -> DataFrame:
    """(protein_id, peptide_id, condition, value): exact medians."""
    return df.groupBy(PROTEIN, PEPTIDE, CONDITION).agg(F.median(value).alias("value"))


def profiles(df: DataFrame, levels: tuple[str, ...], value: str = NORMALIZED) -> DataFrame:
    """(protein_id, peptide_id, profile): medians in the order of the levels, 0 for a condition without values."""
    found = condition_medians(df, value).groupBy(PROTEIN, PEPTIDE).agg(F.map_from_entries(F.collect_list(F.struct(CONDITION, "value"))).alias("m"))
    return found.select(PROTEIN, PEPTIDE, F.array(*(F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0.0)) for c in levels)).alias("profile"))


def profile_distances(table: DataFrame) -> DataFrame:
    """(protein_id, a, b, distance) of the pairs of a protein's peptides, a before b: one grouping by protein, pairs made from its array."""
    grouped = table.groupBy(PROTEIN).agg(F.array_sort(F.collect_list(F.struct(PEPTIDE, "profile"))).alias("all"))
    pairs = grouped.select(PROTEIN, "all", F.posexplode("all").alias("i", "x")).select(PROTEIN, "x", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("y"))
    gap = F.sqrt(F.aggregate(F.zip_with("x.profile", "y.profile", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v))
    return pairs.select(PROTEIN, F.col("x.peptide_id").alias("a"), F.col("y.peptide_id").alias("b"), gap.alias("distance"))


def cluster_table(table: DataFrame, config: Config) -> DataFrame:
    """(protein_id, peptide_id, cluster_id, cut_method, linkage_method) from profiles; one protein in one call of the kernel.

    Proteins are mostly small, so they come in batches, sorted; a protein that a batch cuts waits for its other rows.
    """

    def labelled(rows: pa.Table) -> pa.Table:
        names, values = rows.column(PROTEIN).to_pylist(), rows.column("profile").to_pylist()
        labels = []
        for _, own in itertools.groupby(range(len(names)), names.__getitem__):
            x = np.array([values[i] for i in own], float)
            labels.append(cluster_profiles(x, config))
        return pa.table({PROTEIN: rows.column(PROTEIN), PEPTIDE: rows.column(PEPTIDE), "cluster_id": pa.array(np.concatenate(labels).astype(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # rows of one protein, the last
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_pylist()
            first = next((i for i in range(len(names) - 1, 0, -1) if names[i - 1] != names[-1]), 0)
            if waiting and (first or waiting[-1].column(0)[0].as_py() != names[0]):
                yield from labelled(pa.Table.from_batches([*waiting, batch.slice(0, first)])).to_batches()
                waiting = []
            elif first:
                yield from labelled(pa.Table.from_batches([batch.slice(0, first)])).to_batches()
            waiting.append(batch.slice(first))
        if waiting:
            yield from labelled(pa.Table.from_batches(waiting)).to_batches()

    rows = table.select(PROTEIN, PEPTIDE, "profile").repartition(PROTEIN).sortWithinPartitions(PROTEIN, F.col(PEPTIDE).asc_nulls_last())
    got = rows.mapInArrow(run, "protein_id string, peptide_id string, cluster_id long")
    return got.withColumn("cut_method", F.lit(config.cut)).withColumn("linkage_method", F.lit(config.linkage))
