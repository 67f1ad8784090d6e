"""Column names, table schemas and the closed contracts of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillon.errors import ContractError

PROTEIN, PEPTIDE, SAMPLE, CONDITION = "protein_id", "peptide_id", "sample_id", "condition"
INTENSITY, NORMALIZED, WEIGHT = "intensity", "intensity_normalized", "weight"
IS_REAL, IS_MISSING = "is_real", "is_complete_missing"
KEY = (PROTEIN, PEPTIDE, SAMPLE)
REQUIRED = (*KEY, INTENSITY)
OPTIONAL = (IS_REAL, IS_MISSING, WEIGHT)
TYPES = {PROTEIN: "string", PEPTIDE: "string", SAMPLE: "string", CONDITION: "string", INTENSITY: "double", WEIGHT: "double", NORMALIZED: "double", IS_REAL: "boolean", IS_MISSING: "boolean"}


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


DISCORDANCE = _fields(protein_id=T.StringType(), peptide_id=T.StringType(), raw_p_value=T.DoubleType(), within_p_value=T.DoubleType(), adjusted_p_value=T.DoubleType(), is_discordant=T.BooleanType(), fit_status=T.StringType())
CLUSTERS = _fields(protein_id=T.StringType(), peptide_id=T.StringType(), cluster_id=T.LongType(), cut_method=T.StringType(), linkage_method=T.StringType())
MAPPING = _fields(protein_id=T.StringType(), peptide_id=T.StringType(), is_discordant=T.BooleanType(), cluster_id=T.LongType(), dpf_id=T.LongType())
FASTA = _fields(
    entry=T.StringType(), entryName=T.StringType(), geneName=T.StringType(), proteinDescription=T.StringType(), reviewStatus=T.StringType(), organism=T.StringType(),
    taxonomyId=T.LongType(), proteinExistence=T.LongType(), sequenceVersion=T.LongType(), isoformStatus=T.StringType(), sequenceLength=T.LongType(), molecularWeight_kDa=T.DoubleType(), sequence=T.StringType(),
)


def require(df: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """df, if its columns are exactly those of schema; missing and extra columns both raise."""
    have, want = set(df.columns), set(schema.fieldNames())
    if have != want:
        raise ContractError(f"{what}: missing columns {sorted(want - have)}, unexpected columns {sorted(have - want)}")
    return df
