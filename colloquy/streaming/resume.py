"""Append-only work as a stream: every new record once, finished ones never again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def record_stream(spark: SparkSession, folder: str, schema: StructType, per_batch: int = 16) -> DataFrame:
    """A folder of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def process_new(records: DataFrame, keys: list[str], out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], event_time: str | None = None, late: str = "7 days") -> StreamingQuery:
    """Rows whose key has not come before, one per key, go through step and are written, each batch to its own folder out/batch=<n>.

    Keys that have been seen are kept in the stream's state beside its checkpoint, so
    finished work is never read again; with event_time a watermark bounds that state. A
    batch that is tried again after a failure overwrites its folder.
    """
    once = records.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys) if event_time else records.dropDuplicates(keys)

    def batch(df: DataFrame, n: int) -> None:
        step(df).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
