"""Sketches of streams: every micro-batch of fingerprints is folded and merged into a stored sketch, which is linear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.sketch import CELLS, merge, sketch


def maintain(rows: DataFrame, path: str, checkpoint: str, cells: int, seed: int = 0) -> StreamingQuery:
    """Append the sketch of every micro-batch of rows(fp, id) to `path`, partitioned by batch; replays of a batch overwrite it."""

    def fold(batch: DataFrame, number: int) -> None:
        sketch(batch, cells, seed).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The sketch of everything seen so far."""
    return merge(spark.read.schema(f"{CELLS}, batch long").parquet(path).drop("batch"))
