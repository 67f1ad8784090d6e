"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.staging import shared_dir

#: Word separators of the corpus contracts: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


_STAGED: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses, noted for release()."""
    _STAGED.append(f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}")
    return _STAGED[-1]


def release(spark: SparkSession) -> int:
    """Delete what this process has written to the shared folder so far, staged tables, token shards and archives, when no result that reads it is needed any more; their number."""
    n = len(_STAGED)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later steps start from files that survive lost executors.

    The files stay until release() or until the folder's owner clears it.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcasting if it has at most so many rows; else df, and Spark joins by shuffling. Counts, so df should be cheap."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def word_array(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def word_count(text: Column) -> Column:
    """How many words `[^\\x20\\x09-\\x0D]+` a text has; 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("long")
