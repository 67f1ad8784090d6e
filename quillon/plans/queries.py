"""Registered queries: every operator applied to the driver's tables.

The long table is lineitem by supplier (protein), part type (peptide) and shipping year (sample), with the mean price as
intensity; years are grouped into three conditions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import Config
from quillon.functions import correction
from quillon.functions.protein import header_fields, valid_sequence, weight_kda
from quillon.operators import audit, cells, cluster, codes, ingest, mapping, normalize, ward, weights
from quillon.plans import stages
from quillon.schema import CONDITION, INTENSITY, KEY, NORMALIZED, PEPTIDE, PROTEIN, SAMPLE
from quillon.sources.fasta import annotate, skip_counts
from quillon.staging import fixed

CONDITIONS = {"mid": ("Y1997", "Y1998"), "control": ("Y1995", "Y1996"), "late": ("Y1999", "Y2000", "Y2001")}
CONFIG = Config(control_condition="control", conditions=CONDITIONS, model="wls", fdr=0.2)
DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, DIGITS) + 0.0  # no negative zero


def long_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """protein_id, peptide_id, sample_id, intensity, and masks made from the number of rows."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    keys = (F.col("l_suppkey").alias("s"), F.col("p_type").alias("t"), F.year("l_shipdate").alias("y"))  # short keys: text is made of sums only
    got = rows.groupBy(*keys).agg(F.avg("l_extendedprice").alias(INTENSITY), F.count(F.lit(1)).alias("n"))
    named = (F.col("s").cast("string").alias(PROTEIN), F.col("t").alias(PEPTIDE), F.concat(F.lit("Y"), F.col("y")).alias(SAMPLE))
    return got.select(*named, INTENSITY, (F.col("n") % 3 != 0).alias("is_real"), (F.col("n") % 2 == 0).alias("is_complete_missing"))


def prepared(spark: SparkSession, sf_dir: str, config: Config = CONFIG):
    """The normalized table with the audits; lineitem, which is much larger than the long table, is joined and summed once."""
    return stages.prepare(fixed(long_table(spark, sf_dir), "long"), config)


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalized table without the audits."""
    return stages.prepare(fixed(ingest.in_scope(long_table(spark, sf_dir), CONFIG), "long"), CONFIG, check=False).peptides


def pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.wls_pvalues(plain(spark, sf_dir), F.lit(1.0), 3)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA entries made from part: some malformed, some without a gene, some with letters that are no amino acids."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    accession = F.concat(F.lit("P"), F.lpad(k.cast("string"), 5, "0"), F.when(k % 7 == 0, "-2").otherwise(""))
    gene = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" GN=G"), k.cast("string")))
    text = F.concat(F.when(k % 2 == 0, "sp").otherwise("tr"), F.when(k % 11 == 0, " ").otherwise("|"), accession, F.lit("|"), accession, F.lit("_X "), F.col("p_name"), F.lit(" OS=Homo sapiens OX="), F.col("p_size").cast("string"), gene, F.lit(" PE="), (k % 5).cast("string"), F.lit(" SV=x"))
    letters = F.upper(F.regexp_replace(F.concat("p_name", "p_type"), "[^A-Za-z]", ""))
    return p.select(k.alias("k"), text.alias("header"), F.when(k % 3 == 0, F.substring(letters, 1, 5)).when(k % 4 == 0, F.regexp_replace(letters, "[OUBZJX]", "G")).otherwise(F.concat(letters, F.when(k % 10 == 1, "*").otherwise(""))).alias("sequence"))


def scan_project_filter(spark, sf_dir):
    return ingest.in_scope(long_table(spark, sf_dir), CONFIG).select(*KEY, rounded(INTENSITY).alias(INTENSITY))


def harmonize_rename_cast(spark, sf_dir):
    from quillon.config import ColumnMap

    names = ColumnMap(protein_id="l_suppkey", peptide_id="l_linenumber", sample_id="l_orderkey", intensity="l_extendedprice")
    rows = ingest.harmonize_columns(ingest.mapped_only(table(spark, sf_dir, "lineitem"), names), names)
    return ingest.coerced(rows).select(*KEY, INTENSITY)


def protein_group_resolve(spark, sf_dir):
    group = F.concat(F.col("p_name"), F.lit(";P"), F.lpad(F.col("p_partkey").cast("string"), F.lit(4) + (F.col("p_partkey") % 3).cast("int"), F.lit("0")), F.lit(";Q12345"))
    group = F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).otherwise(group)
    return table(spark, sf_dir, "part").select("p_partkey", ingest.representative(group).alias("accession"))


def attach_conditions(spark, sf_dir):
    return ingest.attach_conditions(long_table(spark, sf_dir), CONFIG.replace(conditions={k: v[:2] for k, v in CONDITIONS.items()})).select(*KEY, CONDITION)


def scope_audit(spark, sf_dir):
    asked = sorted(CONFIG.selected_sample_ids | {"Y1900"})
    want = spark.createDataFrame([(s,) for s in asked], "asked string")
    have = audit.present_samples(long_table(spark, sf_dir))
    both = have.join(want, F.col(SAMPLE) == F.col("asked"), "full")
    return both.select(F.coalesce(SAMPLE, "asked").alias("sample"), F.col(SAMPLE).isNotNull().alias("present"), F.col("asked").isNotNull().alias("configured"))


def duplicate_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias(PROTEIN), F.col("l_linenumber").alias(PEPTIDE), F.year("l_shipdate").cast("long").alias(SAMPLE))
    return audit.duplicate_keys(rows)


def min_peptide_offenders(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias(PROTEIN), F.col("l_partkey").alias(PEPTIDE))
    return audit.offenders(rows, 520)


def intensity_audit(spark, sf_dir):
    v = F.col("l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 97 == 0, F.lit(None)).when(F.col("l_orderkey") % 89 == 0, float("nan")).when(F.col("l_orderkey") % 83 == 0, float("inf")).when(F.col("l_orderkey") % 79 == 0, -v).otherwise(v).alias(INTENSITY))
    return audit.intensity_audit(rows, True).withColumn("nan_fraction", rounded("nan_fraction"))


def provenance(spark, sf_dir):
    return long_table(spark, sf_dir).select(*KEY, "is_real", "is_complete_missing")


def provenance_join(spark, sf_dir):
    rows = long_table(spark, sf_dir).select(*KEY, INTENSITY)
    return weights.attach_provenance(rows, provenance(spark, sf_dir)).select(*KEY, rounded(INTENSITY).alias(INTENSITY), "is_real", "is_complete_missing")


def provenance_anti_missing(spark, sf_dir):
    return weights.unmatched(provenance(spark, sf_dir), long_table(spark, sf_dir).where(~F.col(PROTEIN).endswith("3")))


def provenance_anti_extra(spark, sf_dir):
    return weights.unmatched(long_table(spark, sf_dir), provenance(spark, sf_dir).where(~F.col(SAMPLE).endswith("7")))


def weight_tiers(spark, sf_dir):
    rows = long_table(spark, sf_dir)
    return rows.select(*KEY, weights.row_weights(rows, "wls", 0.5).alias("weight"))


def sample_stats(spark, sf_dir):
    got = normalize.sample_stats(long_table(spark, sf_dir).withColumn("y", F.log2(INTENSITY)))
    return got.select(SAMPLE, "n", rounded("mean").alias("mean"), rounded("std").alias("std"))


def normalize_long(spark, sf_dir):
    return prepared(spark, sf_dir).peptides.select(*KEY, CONDITION, rounded(NORMALIZED).alias(NORMALIZED))


def peptide_codes(spark, sf_dir):
    return codes.peptide_codes(long_table(spark, sf_dir))


def protein_ordinal(spark, sf_dir):
    return codes.protein_ordinal(long_table(spark, sf_dir))


def wls_cells(spark, sf_dir):
    got = cells.cells(plain(spark, sf_dir), F.lit(1.0))
    return got.select(PROTEIN, PEPTIDE, CONDITION, "n", "n_all", "n_peptides", *(rounded(c).alias(c) for c in ("w1", "s1", "q1", "w0", "s0", "q0")))


def wls_stat(spark, sf_dir):
    got = cells.wls_stats(cells.cells(plain(spark, sf_dir), F.lit(1.0)), 3)
    return got.select(PROTEIN, PEPTIDE, "n_rows", "n_cells", "df", rounded("ssr").alias("ssr"), rounded("wald_sum").alias("wald_sum"))


def wls_pvalue(spark, sf_dir):
    return pvalues(spark, sf_dir).select(PROTEIN, PEPTIDE, rounded("raw_p_value").alias("raw_p_value"), "fit_status")


def weighted_pvalues(spark, sf_dir):
    rows = plain(spark, sf_dir)
    return cells.wls_pvalues(rows, weights.row_weights(rows, "wls", 0.5), 3)


def wls_weighted_pvalue(spark, sf_dir):
    return weighted_pvalues(spark, sf_dir).select(PROTEIN, PEPTIDE, rounded("raw_p_value").alias("raw_p_value"), "fit_status")


def fit_status_counts(spark, sf_dir):
    rows = plain(spark, sf_dir).where(~(F.col(PROTEIN).endswith("5") & (F.col(CONDITION) == "mid") & (F.col(PEPTIDE) == "ECONOMY")))
    return cells.wls_pvalues(rows, F.lit(1.0), 3).groupBy("fit_status").agg(F.count(F.lit(1)).alias("n"))


def _global(method: str) -> Callable:
    def query(spark, sf_dir):
        got = correction.adjust(pvalues(spark, sf_dir), method, "raw_p_value", "adjusted")
        return got.select(PROTEIN, PEPTIDE, rounded("adjusted").alias("adjusted"))

    return query


def _within(method: str) -> Callable:
    def query(spark, sf_dir):
        got = correction.adjust_within(pvalues(spark, sf_dir), method, PROTEIN, "raw_p_value", "adjusted")
        return got.select(PROTEIN, PEPTIDE, rounded("adjusted").alias("adjusted"))

    return query


def pi0_lambda_curve(spark, sf_dir):
    got = correction.lambda_curve(pvalues(spark, sf_dir), "raw_p_value")
    return got.select(F.round("lambda", 2).alias("lambda"), "n_above", rounded("pi0").alias("pi0"))


def pi0_bootstrap(spark, sf_dir):
    return correction.pi0_bootstrap(pvalues(spark, sf_dir), "raw_p_value").select(rounded("pi0").alias("pi0"))


def discordance_wls(spark, sf_dir):
    got = stages.run_discordance(prepared(spark, sf_dir)).table
    return got.select(PROTEIN, PEPTIDE, *(rounded(c).alias(c) for c in ("raw_p_value", "within_p_value", "adjusted_p_value")), "is_discordant", "fit_status")


def discordance_rlm(spark, sf_dir):
    got = stages.run_discordance(prepared(spark, sf_dir, CONFIG.replace(model="rlm"))).table
    return got.select(PROTEIN, PEPTIDE, *(rounded(c).alias(c) for c in ("raw_p_value", "within_p_value", "adjusted_p_value")), "is_discordant", "fit_status")


def condition_profiles(spark, sf_dir):
    got = cluster.condition_medians(plain(spark, sf_dir))
    return got.select(PROTEIN, PEPTIDE, CONDITION, rounded("value").alias("value"))


def _profiles(spark, sf_dir):
    return cluster.profiles(plain(spark, sf_dir), CONFIG.condition_levels)


def profile_distances(spark, sf_dir):
    return cluster.profile_distances(_profiles(spark, sf_dir)).withColumn("distance", rounded("distance"))


def _clusters(cut: str) -> Callable:
    def query(spark, sf_dir):
        return cluster.cluster_table(_profiles(spark, sf_dir), CONFIG.replace(cut=cut))

    return query


def silhouette_given_labels(spark, sf_dir):
    """Silhouettes of the split of peptides by their first letter, as the kernel has them."""
    import numpy as np
    import pyarrow as pa

    def run(rows: pa.Table) -> pa.Table:
        names = rows.column(PEPTIDE).to_pylist()
        labels = np.array([1 if n < "M" else 2 for n in names])
        d = ward.distances(np.array(rows.column("profile").to_pylist(), float))
        return pa.table({PROTEIN: rows.column(PROTEIN), PEPTIDE: rows.column(PEPTIDE), "score": pa.array(ward.silhouette(d, labels))})

    got = _profiles(spark, sf_dir).groupBy(PROTEIN).applyInArrow(run, "protein_id string, peptide_id string, score double")
    return got.withColumn("score", rounded("score"))


def _labelled(spark, sf_dir):
    """Peptides with a flag and a cluster by rule."""
    return pvalues(spark, sf_dir).select(PROTEIN, PEPTIDE, (F.col("raw_p_value") < 0.3).alias("is_discordant"), F.when(F.col(PEPTIDE) < "L", 1).when(F.col(PEPTIDE) < "Q", 2).otherwise(3).cast("long").alias("cluster_id"))


def dpf_assignment(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return mapping.map_peptides(rows, rows, rows)


def dpf_counts(spark, sf_dir):
    return dpf_assignment(spark, sf_dir).groupBy("dpf_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_discordant").alias("n_discordant"))


def fasta_header_parse(spark, sf_dir):
    return entries(spark, sf_dir).select("k", *(v.cast("string").alias(c) for c, v in header_fields(F.col("header")).items()))


def sequence_validity(spark, sf_dir):
    return entries(spark, sf_dir).select("k", valid_sequence(F.col("sequence")).alias("valid"), valid_sequence(F.col("sequence"), False).alias("valid_strict"))


def molecular_weight(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return rows.where(valid_sequence(F.col("sequence"))).select("k", rounded(weight_kda(F.col("sequence"))).alias("kda"))


def fasta_skip_counts(spark, sf_dir):
    return skip_counts(annotate(entries(spark, sf_dir), gene_only=True, allow_ambiguous=False))


def analysis_end_to_end(spark, sf_dir):
    data = prepared(spark, sf_dir)
    found = stages.run_discordance(data)
    clusters = stages.run_cluster(data, found)
    return stages.assign_proteoforms(data, found, clusters, check=False).table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain_ones = (
        scan_project_filter, harmonize_rename_cast, protein_group_resolve, attach_conditions, scope_audit, duplicate_keys, min_peptide_offenders, intensity_audit,
        provenance_join, provenance_anti_missing, provenance_anti_extra, weight_tiers, sample_stats, normalize_long, peptide_codes, protein_ordinal,
        wls_cells, wls_stat, wls_pvalue, wls_weighted_pvalue, fit_status_counts, pi0_lambda_curve, pi0_bootstrap, discordance_wls, discordance_rlm,
        condition_profiles, profile_distances, silhouette_given_labels, dpf_assignment, dpf_counts,
        fasta_header_parse, sequence_validity, molecular_weight, fasta_skip_counts, analysis_end_to_end,
    )
    out = {q.__name__: q for q in plain_ones}
    for name in ("bonferroni", "holm", "hochberg", "fdr_bh", "BY", "hommel", "qvalue"):
        out[f"adjust_{name.lower()}"] = _global(name)
        out[f"adjust_{name.lower()}_within"] = _within(name)
    for name in ("dynamic_tree", "fixed_height", "hybrid_outlier"):
        out[f"cluster_{name}"] = _clusters(name)
    return out
