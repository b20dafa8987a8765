"""Incremental index maintenance: micro-batches of postings and interactions kept up to date (an extension; batch jobs don't need it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindrift.operators.storage import upsert


def maintain(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], keys: list[str], checkpoint: str) -> StreamingQuery:
    """Upserts every micro-batch into the table behind ``read`` and ``write``; the latest row of a key in a batch wins.

    ``write`` gets the batch number, so that a repeated batch can replace its own output.
    """

    def step(batch: DataFrame, number: int) -> None:
        value = [c for c in batch.columns if c not in keys and c != "indexed_at"]
        latest = batch.groupBy(*keys).agg(F.max(F.struct("indexed_at", *value)).alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in ["indexed_at", *value]])
        write(upsert(read(), latest, keys), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def interaction_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
