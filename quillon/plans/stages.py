"""The stages of an analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillon import schema
from quillon.config import Config
from quillon.errors import ContractError
from quillon.functions.correction import adjust, adjust_within, keep
from quillon.operators import audit
from quillon.operators.cells import wls_pvalues
from quillon.operators.cluster import cluster_table, profiles
from quillon.operators.ingest import attach_conditions, in_scope, mapped_only, peptide_columns, typed
from quillon.operators.mapping import check_mapping, map_peptides
from quillon.operators.normalize import normalize_control_relative_long
from quillon.operators.rlm import rlm_pvalues
from quillon.operators.weights import attach_provenance, row_weights
from quillon.results import ClusterResult, DiscordanceResult, PreparedDataset, ProteoformMappingResult
from quillon.schema import CONDITION, NORMALIZED, PEPTIDE, PROTEIN
from quillon.sources.tables import scan

#: A model makes (protein_id, peptide_id, raw_p_value, fit_status) from a prepared dataset; others can be added.
Model = Callable[[PreparedDataset], DataFrame]
MODELS: dict[str, Model] = {}


def _wls(prepared: PreparedDataset) -> DataFrame:
    weight = row_weights(prepared.peptides, "wls", prepared.config.wls_biological_weight)
    return wls_pvalues(prepared.peptides, weight, len(prepared.condition_levels))


def _rlm(prepared: PreparedDataset) -> DataFrame:
    return rlm_pvalues(prepared.peptides, prepared.condition_levels)


MODELS.update(wls=_wls, rlm=_rlm)


def select_model(name: str) -> Model:
    if name not in MODELS:
        raise ContractError(f"model {name!r} is not supported; valid: {sorted(MODELS)}")
    return MODELS[name]


def prepare(peptides: DataFrame, config: Config, provenance: DataFrame | None = None, check: bool = True) -> PreparedDataset:
    """Validated and normalized peptides. With check, the audits run now, in one run of peptides; the table itself stays lazy.

    With check, the first stage that needs the table makes it, in one more run of peptides, and it is kept for the others.
    """
    every = typed(peptides, config)
    rows = in_scope(every, config)
    if provenance is not None:
        rows = attach_provenance(rows, provenance)
    rows = peptide_columns(attach_conditions(rows, config))
    metadata, stats = {}, None
    if check:
        got, samples = audit.summary(every, config)
        metadata = audit.scope([r["sample"] for r in samples], config) | audit.check(rows, config, got)
        stats = [Row(sample_id=r["sample"], mean=r["mean"], std=r["std"]) for r in samples if r["sample"] in config.selected_sample_ids]
        metadata["finite"] &= all(r.std is not None for r in stats)
    rows = normalize_control_relative_long(rows, config.conditions[config.control_condition], config.input_is_log2, check=check, stats=stats)
    return PreparedDataset(config, keep(rows) if check else rows, config.ordered_sample_ids, config.condition_levels, metadata | {"control_condition": config.control_condition})


def prepare_from_parquet(spark: SparkSession, path: str, config: Config, provenance: DataFrame | None = None) -> PreparedDataset:
    """prepare() of a Parquet, CSV or TSV file."""
    return prepare(mapped_only(scan(spark, path, "peptide"), config.column_map), config, provenance)


def corrected(raw: DataFrame, config: Config) -> DataFrame:
    """raw with p-values corrected within proteins, then over all, and the flag.

    The table-wide correction runs what it corrects once and writes it, one row a peptide.
    """
    within = adjust_within(raw, config.correction_within, PROTEIN, "raw_p_value", "within_p_value")
    both = adjust(within, config.correction_global, "within_p_value", "adjusted_p_value")
    flag = F.coalesce(F.col("adjusted_p_value") <= config.fdr, F.lit(False))
    return both.withColumn("is_discordant", flag).select(*schema.DISCORDANCE.fieldNames())


def run_discordance(prepared: PreparedDataset, batching: str = "shape", show_progress: bool = False, n_jobs: int | None = None) -> DiscordanceResult:
    """Tests of every peptide against its protein's others. batching, show_progress and n_jobs are accepted; Spark plans the work."""
    if batching not in ("shape", "protein", "none", "serial"):
        raise ContractError(f"unknown batching {batching!r}")
    bad = F.col(NORMALIZED).isNull() | audit.not_finite(F.col(NORMALIZED))
    if not prepared.metadata.get("finite") and not prepared.peptides.where(bad).isEmpty():
        raise ContractError("normalized intensities must be finite")
    return DiscordanceResult(prepared.config, schema.require(corrected(select_model(prepared.config.model)(prepared), prepared.config), schema.DISCORDANCE, "discordance table"))


def _same(a: Config, b: Config) -> None:
    if a != b:
        raise ContractError("the stages were run with different settings")


#: Makes (protein_id, peptide_id, profile array<double>) from the results of both stages before; others can be given to run_cluster.
ProfileBuilder = Callable[[PreparedDataset, DiscordanceResult], DataFrame]


def median_profiles(prepared: PreparedDataset, discordance: DiscordanceResult) -> DataFrame:
    """Medians by condition of all peptides."""
    return profiles(prepared.peptides, prepared.condition_levels)


def run_cluster(prepared: PreparedDataset, discordance: DiscordanceResult, show_progress: bool = False, n_jobs: int | None = None, builder: ProfileBuilder = median_profiles) -> ClusterResult:
    """Clusters of every protein's peptides by the profiles that builder makes."""
    _same(prepared.config, discordance.config)
    schema.require(discordance.table, schema.DISCORDANCE, "discordance table")
    known = F.col(CONDITION).isin(list(prepared.condition_levels))
    if not prepared.metadata.get("finite") and not prepared.peptides.where(~known | audit.not_finite(F.col(NORMALIZED))).isEmpty():
        raise ContractError("profiles need known conditions and finite values")
    return ClusterResult(prepared.config, schema.require(cluster_table(builder(prepared, discordance), prepared.config), schema.CLUSTERS, "cluster table"))


def assign_proteoforms(prepared: PreparedDataset, discordance: DiscordanceResult, cluster: ClusterResult, check: bool = True) -> ProteoformMappingResult:
    """Differential group numbers of all peptides."""
    _same(prepared.config, discordance.config)
    _same(prepared.config, cluster.config)
    table = map_peptides(prepared.peptides.select(PROTEIN, PEPTIDE), discordance.table, cluster.table)
    return ProteoformMappingResult(prepared.config, schema.require(check_mapping(table) if check else table, schema.MAPPING, "mapping table"))
