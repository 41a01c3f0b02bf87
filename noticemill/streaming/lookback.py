"""A stream whose state is bounded by event time, and whose rows are bounded by a wall-clock lookback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from .ingest import deduplicated


@dataclass(frozen=True)
class Progress:
    """What a run has done: batches, rows read, rows dropped since they came behind the watermark, state after each batch."""

    batches: int
    rows_read: int
    dropped_late: int
    state_rows: tuple[int, ...]


def within(stream: DataFrame, keys: list[str], time: str, oldest: Column, lateness: str) -> DataFrame:
    """The first row of each key among those not older than the lookback.

    The lookback is a filter by the clock, the same for all batches. The watermark follows the latest event and says how
    long a key is remembered: within that time each key comes once; a row behind it is dropped, whether new or not.
    """
    return deduplicated(stream.where(stream[time] >= oldest), keys, time, lateness)


def run_within(spark: SparkSession, source: DataFrame, keys: list[str], time: str, oldest: Column, target: str, checkpoint: str, lateness: str = "7 days", recent: int = 10_000) -> Progress:
    """Run over what is there, batch by batch, into target as Parquet; a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    kept = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(kept)
    spark.conf.set(kept, str(recent))  # figures of so many batches are kept
    try:
        query = within(source, keys, time, oldest, lateness).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        done = [p for p in query.recentProgress if p.stateOperators]
    finally:
        spark.conf.set(kept, before)
    return Progress(
        len({p.batchId for p in done}),
        sum(p.numInputRows for p in done),
        sum(o.numRowsDroppedByWatermark for p in done for o in p.stateOperators),
        tuple(sum(o.numRowsTotal for o in p.stateOperators) for p in done),
    )
