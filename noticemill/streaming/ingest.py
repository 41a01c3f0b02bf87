"""Incremental ingest: new files through a keyed, bounded deduplication into a batch function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def deduplicated(stream: DataFrame, keys: list[str], time: str | None = None, lateness: str = "7 days") -> DataFrame:
    """First row of each key. With an event time, state is kept for the lateness only."""
    if time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there, resumably, and stop."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_distinct(spark: SparkSession, source: DataFrame, keys: list[str], target: str, checkpoint: str) -> DataFrame:
    """Distinct keys of a streaming source, appended to target as Parquet; batches that are repeated overwrite theirs."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    run_available(deduplicated(source.select(*keys), keys), write, checkpoint)
    return spark.read.parquet(target).select(*keys)
