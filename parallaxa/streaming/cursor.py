"""Cursor-driven, exactly-once batches on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType


@dataclass(frozen=True)
class Sink:
    """A folder with one subfolder for each batch: writing a batch again replaces it, so a batch that was cut off
    between its rows and its commit is published once."""

    path: str

    def publish(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        return spark.read.schema(StructType([*schema.fields]).add("batch_id", IntegerType())).parquet(self.path)


def micro_batches(
    spark: SparkSession, pattern: str, schema: StructType, sink: Sink, checkpoint: str,
    step: Callable[[DataFrame], DataFrame], files_per_batch: int = 8,
) -> None:
    """Runs `step` over every file that `checkpoint` has not seen, a bounded number of files a batch, then stops.

    The checkpoint is the durable cursor: a later call goes on after the last committed batch. Late rows are rows of
    new files; what was read is never visited again.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    query = (
        source.writeStream.foreachBatch(lambda rows, batch_id: sink.publish(step(rows), batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def windowed_counts(rows: DataFrame, at: str, key: str, window: str, lateness: str) -> DataFrame:
    """(start, key, events): counts of event-time windows; rows later than `lateness` are dropped by a stream."""
    return (
        rows.withWatermark(at, lateness)
        .groupBy(F.window(at, window).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("start"), key, "events")
    )
