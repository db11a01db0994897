"""Checkpointed micro-batches with Structured Streaming, and event-time extras on ``events``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, flatten: Callable[[DataFrame], dict[str, DataFrame]], files_per_batch: int = 1) -> StreamingQuery:
    """Read JSON files in micro-batches and write each batch's tables under its batch id.

    A batch that is run again overwrites its own folder, so a restart repeats nothing; the
    checkpoint is the run's contract and its single writer.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for name, df in flatten(batch).items():
                df.write.mode("overwrite").parquet(f"{target}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_quarantine(target: str, keep: str, year: str = "year") -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that splits rows by a condition and drops none: the rest goes to a quarantine table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = F.coalesce(F.expr(keep), F.lit(False))
        batch.filter(held).write.mode("overwrite").parquet(f"{target}/kept/batch={batch_id}")
        batch.filter(~held).write.mode("overwrite").parquet(f"{target}/quarantine/batch={batch_id}")

    return write


def distinct_records(stream: DataFrame, identity: str) -> DataFrame:
    """Stateful de-duplication by id, without a watermark that could drop late records."""
    return stream.dropDuplicates([identity])


def unfinished(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items without a completed row: what a resumed run still has to do."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def tumbling_counts(events: DataFrame, width: str = "1 hour", delay: str | None = "10 minutes") -> DataFrame:
    """Events by type and window; the same plan serves batch and stream."""
    rows = events.withWatermark("ts", delay) if delay and events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = "1 hour") -> DataFrame:
    """Sessions of each user by inactivity gap."""
    rows = events.withWatermark("ts", delay) if delay and events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
