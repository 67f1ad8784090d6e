"""Relational and per-protein operators."""
