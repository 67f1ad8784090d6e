"""Analyses over a stream of complete studies.

Normalization needs all rows of a sample, so rows cannot be processed one by one: a micro-batch must hold whole samples. Each
batch goes through the batch stages and its results are handed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillon.config import Config
from quillon.plans.stages import prepare, run_discordance


def discordance_stream(stream: DataFrame, config: Config, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs prepare() and run_discordance() on every micro-batch and gives sink its table and number; the checkpoint makes restarts go on where they stopped."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(run_discordance(prepare(batch, config)).table, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
