"""What the stages hand to each other."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.config import Config
from quillon.schema import PEPTIDE, PROTEIN


@dataclass
class PreparedDataset:
    """The validated long table with normalized intensities. The table is lazy; counts run when asked for."""

    config: Config
    peptides: DataFrame
    sample_ids: tuple[str, ...]
    condition_levels: tuple[str, ...]
    metadata: dict[str, Any] = field(default_factory=dict)

    @property
    def control_condition(self) -> str:
        return self.config.control_condition

    @cached_property
    def n_proteins(self) -> int:
        return self.peptides.select(PROTEIN).distinct().count()

    @cached_property
    def n_peptides(self) -> int:
        return self.peptides.select(PROTEIN, PEPTIDE).distinct().count()

    @property
    def n_samples(self) -> int:
        return len(self.sample_ids)

    def protein_index(self) -> DataFrame:
        """(protein_id, protein_index): the place of each protein in sorted order, from 0."""
        from quillon.operators.codes import protein_ordinal

        return protein_ordinal(self.peptides)


@dataclass
class DiscordanceResult:
    """One row per peptide: p-values, flag and fit status."""

    config: Config
    table: DataFrame

    @cached_property
    def metadata(self) -> dict[str, Any]:
        row = self.table.agg(
            F.count(F.lit(1)).alias("n_peptides"),
            F.count("raw_p_value").alias("n_tested"),
            F.count_if("is_discordant").alias("n_discordant"),
            F.count_if(F.col("raw_p_value").isNull()).alias("n_skipped"),
        ).first()
        statuses = {r.fit_status: r["count"] for r in self.table.groupBy("fit_status").count().orderBy("fit_status").collect()}
        return row.asDict() | {"fit_status_counts": statuses, "model": self.config.model, "fdr": self.config.fdr, "correction_within": self.config.correction_within, "correction_global": self.config.correction_global}

    @property
    def n_discordant(self) -> int:
        return self.metadata["n_discordant"]

    @property
    def discordant(self) -> DataFrame:
        return self.table.where("is_discordant")


@dataclass
class ClusterResult:
    """One row per peptide: its cluster within the protein."""

    config: Config
    table: DataFrame

    @cached_property
    def n_clusters(self) -> int:
        return self.table.select(PROTEIN, "cluster_id").distinct().count()

    @cached_property
    def n_singletons(self) -> int:
        return self.table.groupBy(PROTEIN, "cluster_id").count().where("count = 1").count()


@dataclass
class ProteoformMappingResult:
    """One row per peptide: cluster and differential group number."""

    config: Config
    table: DataFrame

    @cached_property
    def metadata(self) -> dict[str, Any]:
        return {"n_by_dpf_id": {r.dpf_id: r["count"] for r in self.table.groupBy("dpf_id").count().orderBy("dpf_id").collect()}, "n_differential_peptides": self.n_differential_peptides}

    @cached_property
    def n_differential_peptides(self) -> int:
        return self.table.where("dpf_id > 0").count()
