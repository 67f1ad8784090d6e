"""Bundles: a manifest that names a peptide file and settings."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import yaml

from quillon.config import Config
from quillon.errors import ContractError, SourceError


@dataclass(frozen=True)
class FixtureBundle:
    name: str
    description: str
    root: Path
    files: dict[str, Path]

    def load_config(self) -> Config:
        return Config.from_yaml_path(self.files["config"])


def load_fixture_bundle(manifest: str | Path) -> FixtureBundle:
    """A manifest of name, description and files; the files peptides and config must be named and there."""
    path = Path(manifest)
    if not path.is_file():
        raise SourceError(f"the manifest {path} does not exist")
    data = yaml.safe_load(path.read_text(encoding="utf-8"))
    if not isinstance(data, dict) or not isinstance(data.get("files"), dict):
        raise ContractError("a manifest is a mapping with the entry files")
    if missing := [k for k in ("peptides", "config") if k not in data["files"]]:
        raise ContractError(f"the manifest names no {missing}")
    files = {k: path.parent / str(v) for k, v in data["files"].items()}
    if gone := [str(p) for p in files.values() if not p.is_file()]:
        raise SourceError(f"files of the bundle do not exist: {gone}")
    return FixtureBundle(str(data.get("name", path.parent.name)), str(data.get("description", "")), path.parent, files)
