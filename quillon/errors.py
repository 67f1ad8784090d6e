"""Errors and warnings of the package."""

from __future__ import annotations


class AnalysisError(Exception):
    """Base of all errors raised here."""


class ContractError(AnalysisError):
    """Data or settings break the data contract."""


class SourceError(AnalysisError):
    """A file is missing or cannot be read as what it should be."""


class ScopeWarning(UserWarning):
    """Rows or samples are left out, or nulls were found."""
