"""From clusters and flags to differential group numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.errors import ContractError
from quillon.schema import PEPTIDE, PROTEIN


def numbered(table: DataFrame) -> DataFrame:
    """table with dpf_id from (protein_id, cluster_id, is_discordant), in one run of table: its clusters meet nothing that another run made.

    0 for clusters without a discordant peptide and for peptides without a cluster, -1 for single peptides, else 1, 2, ... in
    the order of the protein's clusters.
    """
    cluster = Window.partitionBy(PROTEIN, "cluster_id")
    got = table.repartition(PROTEIN).withColumn("_n", F.count(F.lit(1)).over(cluster)).withColumn("_any", F.bool_or("is_discordant").over(cluster)).withColumn("_row", F.row_number().over(cluster.orderBy("is_discordant")))
    hit = F.coalesce(F.col("_any"), F.lit(False)) & F.col("cluster_id").isNotNull()
    counts = F.count_if(hit & (F.col("_n") > 1) & (F.col("_row") == 1)).over(Window.partitionBy(PROTEIN).orderBy("cluster_id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return got.withColumn("dpf_id", F.when(~hit, 0).when(F.col("_n") == 1, -1).otherwise(counts).cast("long")).drop("_n", "_any", "_row")


def group_numbers(table: DataFrame) -> DataFrame:
    """(protein_id, cluster_id, dpf_id) from (protein_id, cluster_id, is_discordant)."""
    return numbered(table).groupBy(PROTEIN, "cluster_id").agg(F.first("dpf_id").alias("dpf_id"))


def map_peptides(peptides: DataFrame, flags: DataFrame, clusters: DataFrame) -> DataFrame:
    """(protein_id, peptide_id, is_discordant, cluster_id, dpf_id) of all peptides."""
    keys = [PROTEIN, PEPTIDE]
    rows = peptides.select(*keys).distinct().join(flags.select(*keys, "is_discordant"), keys, "left").join(clusters.select(*keys, "cluster_id"), keys, "left")
    rows = rows.withColumn("is_discordant", F.coalesce("is_discordant", F.lit(False)))
    return numbered(rows).select(*keys, "is_discordant", "cluster_id", "dpf_id")


def check_mapping(table: DataFrame) -> DataFrame:
    """table, if its numbers fit its flags and clusters: one aggregate by cluster, then one over its faults."""
    per = table.groupBy(PROTEIN, "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_discordant").alias("any"), F.min("dpf_id").alias("low"), F.max("dpf_id").alias("high"))
    rules = {
        "a cluster has several numbers": F.col("low") != F.col("high"),
        "a discordant peptide has number 0": F.col("any") & (F.col("low") == 0),
        "a cluster without discordant peptides has a number": ~F.col("any") & (F.col("low") != 0),
        "a single discordant peptide is not -1": F.col("any") & (F.col("n") == 1) & (F.col("low") != -1),
        "a larger cluster is -1": (F.col("n") > 1) & (F.col("low") == -1),
        "a number is below -1": F.col("low") < -1,
    }
    row = per.agg(*(F.count_if(rule).alias(f"c{i}") for i, rule in enumerate(rules.values()))).first()
    if broken := [message for i, message in enumerate(rules) if row[f"c{i}"]]:
        raise ContractError("; ".join(broken))
    return table
