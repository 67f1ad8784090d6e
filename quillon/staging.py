"""Tables in the folder that driver and executors share, from which later steps start.

Floating-point sums depend on the order in which a shuffle brings their rows, so a plan that runs twice may give numbers that
differ in their last bits. Steps that compare such numbers exactly, or join on them, must see one run's rows: those of the files.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a new temporary one where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or (d.get() if (d := sc._jsc.sc().getCheckpointDir()).isDefined() else None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


_FIXED: list[tuple[SparkSession, str]] = []


def fixed(df: DataFrame, name: str) -> DataFrame:
    """df as one run makes it, in files until release(). Where no folder is shared, executors hold it: if one is lost, later steps fail."""
    spark = df.sparkSession
    try:
        path = f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    except RuntimeError:
        return df.localCheckpoint()
    _FIXED.append((spark, path))
    void = {f.name for f in df.schema if isinstance(f.dataType, NullType)}  # Parquet has no such columns
    kept = df.drop(*void)
    kept.write.parquet(path)
    got = spark.read.schema(kept.schema).parquet(path)
    return got.select(*(F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns)) if void else got


def release() -> int:
    """Delete what fixed() has written; the number of tables."""
    n = len(_FIXED)
    while _FIXED:
        spark, path = _FIXED.pop()
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return n
