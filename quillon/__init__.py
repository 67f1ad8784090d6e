"""Differential peptide analytics on Spark."""

from quillon.config import ColumnMap, Config, Design
from quillon.errors import AnalysisError, ContractError, ScopeWarning, SourceError
from quillon.functions.correction import VALID_METHODS, adjust, adjust_within, p_adjust, p_adjust_by_group, release
from quillon.functions.protein import calc_molecular_weight
from quillon.operators.ingest import attach_conditions, materialize_peptide_table
from quillon.operators.ward import select_cut_strategy
from quillon.operators.weights import attach_provenance
from quillon.plans.stages import assign_proteoforms, prepare, prepare_from_parquet, run_cluster, run_discordance, select_model
from quillon.results import ClusterResult, DiscordanceResult, PreparedDataset, ProteoformMappingResult
from quillon.sources.bundle import FixtureBundle, load_fixture_bundle
from quillon.sources.fasta import fasta_to_dataframe, read_fasta, read_fasta_entries
from quillon.sources.tables import design_from_frame, peptides_from_frame, provenance_from_frame, read_design, read_peptides, read_provenance

#: Other names of the same things.
DesignTable, validate_and_prepare = Design, prepare

__version__ = "0.1.0"
__all__ = [n for n in dir() if not n.startswith("_")]
