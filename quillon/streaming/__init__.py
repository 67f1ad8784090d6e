"""Stages over streams of complete sample sets."""
