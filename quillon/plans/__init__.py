"""Stages as plans, and the registered queries."""
