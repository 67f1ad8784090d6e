"""Settings of an analysis: the design, and the choices of every stage."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from quillon import schema
from quillon.errors import ContractError

MODELS, CUTS, LINKAGES = ("rlm", "wls"), ("hybrid_outlier", "fixed_height", "dynamic_tree"), ("ward",)
CORRECTIONS = ("bonferroni", "holm", "hommel", "hochberg", "fdr", "fdr_bh", "BY", "qvalue")


@dataclass(frozen=True)
class ColumnMap:
    """The source's name of every canonical column."""

    protein_id: str = schema.PROTEIN
    peptide_id: str = schema.PEPTIDE
    sample_id: str = schema.SAMPLE
    intensity: str = schema.INTENSITY
    condition: str = schema.CONDITION
    is_real: str = schema.IS_REAL
    is_complete_missing: str = schema.IS_MISSING
    weight: str = schema.WEIGHT

    def pairs(self) -> dict[str, str]:
        """Source name by canonical name."""
        return dataclasses.asdict(self)


@dataclass(frozen=True)
class Design:
    """Samples in order, and which condition each belongs to."""

    sample_ids: tuple[str, ...]
    sample_to_condition: dict[str, str]
    condition_to_samples: dict[str, tuple[str, ...]]


@dataclass(frozen=True)
class Config:
    control_condition: str
    conditions: Mapping[str, tuple[str, ...]]
    min_peptides: int = 4
    input_is_log2: bool = False
    column_map: ColumnMap = field(default_factory=ColumnMap)
    model: str = "rlm"
    fdr: float = 0.001
    linkage: str = "ward"
    cut: str = "hybrid_outlier"
    cluster_min_clusters: int = 1
    cluster_max_clusters: int | None = None
    fixed_n_clusters: int = 2
    hybrid_outlier_threshold: float = 0.05
    cluster_min_peptides: int = 2
    n_jobs: int = -1
    wls_biological_weight: float = 0.5
    correction_within: str = "bonferroni"
    correction_global: str = "fdr_bh"

    def __post_init__(self) -> None:
        object.__setattr__(self, "conditions", {str(k): tuple(str(s) for s in v) for k, v in dict(self.conditions or {}).items()})
        self._check_design()
        one_of = {"model": MODELS, "cut": CUTS, "linkage": LINKAGES, "correction_within": CORRECTIONS, "correction_global": CORRECTIONS}
        for name, allowed in one_of.items():
            if getattr(self, name) not in allowed:
                raise ContractError(f"{name} {getattr(self, name)!r} is not supported; valid: {sorted(allowed)}")
        top = self.cluster_max_clusters
        rules = {
            "min_peptides must be at least 2": self.min_peptides >= 2,
            "fdr must lie between 0 and 1, both excluded": 0 < self.fdr < 1,
            "n_jobs must be -1 or positive": self.n_jobs == -1 or self.n_jobs >= 1,
            "wls_biological_weight must lie in (0, 1]": 0 < self.wls_biological_weight <= 1,
            "cluster_min_clusters must be at least 1": self.cluster_min_clusters >= 1,
            "cluster_max_clusters must not be below cluster_min_clusters": top is None or top >= self.cluster_min_clusters,
            "fixed_n_clusters must be at least 1": self.fixed_n_clusters >= 1,
            "cluster_min_peptides must be at least 1": self.cluster_min_peptides >= 1,
            "hybrid_outlier_threshold must lie between -1 and 1": -1 <= self.hybrid_outlier_threshold <= 1,
        }
        for message, holds in rules.items():
            if not holds:
                raise ContractError(message)

    def _check_design(self) -> None:
        if not self.control_condition.strip():
            raise ContractError("control_condition must not be blank")
        if self.control_condition not in self.conditions:
            raise ContractError(f"control_condition {self.control_condition!r} is not among the conditions {sorted(self.conditions)}")
        if len(self.conditions) < 2:
            raise ContractError("at least two conditions are needed")
        owner: dict[str, str] = {}
        for name, samples in self.conditions.items():
            if not name.strip() or any(not s.strip() for s in samples):
                raise ContractError("conditions and samples must not be blank")
            if len(samples) < 2:
                raise ContractError(f"condition {name!r} has fewer than 2 samples")
            for s in samples:
                if s in owner:
                    raise ContractError(f"sample {s!r} stands in {owner[s]!r} and {name!r}; each belongs to one condition")
                owner[s] = name

    @property
    def condition_levels(self) -> tuple[str, ...]:
        """The control first, then the others in their order."""
        return (self.control_condition, *(c for c in self.conditions if c != self.control_condition))

    @property
    def selected_sample_ids(self) -> frozenset[str]:
        return frozenset(s for samples in self.conditions.values() for s in samples)

    @property
    def ordered_sample_ids(self) -> tuple[str, ...]:
        """Samples by condition level."""
        return tuple(s for c in self.condition_levels for s in self.conditions[c])

    def to_design_table(self) -> Design:
        return Design(tuple(s for v in self.conditions.values() for s in v), {s: c for c, v in self.conditions.items() for s in v}, dict(self.conditions))

    def replace(self, **changes: Any) -> Config:
        return dataclasses.replace(self, **changes)

    def to_dict(self) -> dict[str, Any]:
        out = {f.name: getattr(self, f.name) for f in dataclasses.fields(self)}
        return out | {"conditions": {k: list(v) for k, v in self.conditions.items()}, "column_map": self.column_map.pairs()}

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> Config:
        data = dict(data)
        if data.pop("profile_aggregation", "median") != "median":
            raise ContractError("profile_aggregation must be 'median'")
        known = {f.name for f in dataclasses.fields(cls)}
        if unknown := sorted(set(data) - known):
            raise ContractError(f"unknown settings: {unknown}")
        for name in ("control_condition", "conditions"):
            if name not in data:
                raise ContractError(f"the setting {name} is missing")
        if isinstance(data.get("column_map"), Mapping):
            data["column_map"] = ColumnMap(**data["column_map"])
        if isinstance(top := data.get("cluster_max_clusters"), str):
            data["cluster_max_clusters"] = None if top.strip().lower() in ("", "none", "null") else int(top)
        return cls(**data)

    def to_yaml(self) -> str:
        return yaml.safe_dump(self.to_dict(), sort_keys=False)

    @classmethod
    def from_yaml(cls, text: str) -> Config:
        data = yaml.safe_load(text)
        if not isinstance(data, Mapping):
            raise ContractError("the settings must be a mapping")
        return cls.from_dict(data)

    @classmethod
    def from_yaml_path(cls, path: str | Path) -> Config:
        return cls.from_yaml(Path(path).read_text(encoding="utf-8"))

    @classmethod
    def json_schema(cls) -> dict[str, Any]:
        """A JSON Schema of to_dict(), made from the fields and their rules."""
        text, whole = {"type": "string"}, lambda low: {"type": "integer", "minimum": low}
        kinds: dict[str, Any] = {
            "control_condition": text | {"minLength": 1},
            "conditions": {"type": "object", "minProperties": 2, "additionalProperties": {"type": "array", "items": text | {"minLength": 1}, "minItems": 2}},
            "min_peptides": whole(2),
            "input_is_log2": {"type": "boolean"},
            "column_map": {"type": "object", "properties": {k: text for k in ColumnMap().pairs()}, "additionalProperties": False},
            "model": {"enum": list(MODELS)},
            "fdr": {"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 1},
            "linkage": {"enum": list(LINKAGES)},
            "cut": {"enum": list(CUTS)},
            "cluster_min_clusters": whole(1),
            "cluster_max_clusters": {"type": ["integer", "null"], "minimum": 1},
            "fixed_n_clusters": whole(1),
            "hybrid_outlier_threshold": {"type": "number", "minimum": -1, "maximum": 1},
            "cluster_min_peptides": whole(1),
            "n_jobs": {"type": "integer", "minimum": -1, "not": {"const": 0}},
            "wls_biological_weight": {"type": "number", "exclusiveMinimum": 0, "maximum": 1},
            "correction_within": {"enum": list(CORRECTIONS)},
            "correction_global": {"enum": list(CORRECTIONS)},
        }
        for f in dataclasses.fields(cls):
            if f.default is not dataclasses.MISSING:
                kinds[f.name] = kinds[f.name] | {"default": f.default}
        return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Config", "type": "object", "properties": kinds, "required": ["control_condition", "conditions"], "additionalProperties": False}

    @classmethod
    def write_json_schema(cls, path: str | Path) -> Path:
        Path(path).write_text(json.dumps(cls.json_schema(), indent=2) + "\n", encoding="utf-8")
        return Path(path)
