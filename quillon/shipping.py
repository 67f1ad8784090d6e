"""Sends this package to the executors, for clusters on which it is not installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's sources as a zip to the session's Python workers, once per context."""
    sc = spark.sparkContext
    if not getattr(sc, "_quillon_shipped", False):
        root = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="quillon-")) / "quillon.zip"
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as pack:
            for p in sorted(root.rglob("*.py")):
                pack.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(to))
        sc._quillon_shipped = True
    return spark
