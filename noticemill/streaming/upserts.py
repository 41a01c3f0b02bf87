"""A stream of notices into the versioned table: each batch is one version, given twice it changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions
from .ingest import run_available


def upsert_batch(root: str, stream: str, order: str | None = None, update: bool = True, prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A function of (batch, number) that merges a batch into the latest version.

    The version holds the number of the stream's last batch, so that a batch which is given again after a failure is passed
    over. update=False leaves rows alone whose link is stored, as a run does that skips what it has seen.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = versions.latest(spark, root)
        if dict(now.batches).get(stream, -1) >= number:
            return
        rows = prepare(batch) if prepare else batch
        if not update:
            rows = rows.join(versions.read(spark, now).select("link"), "link", "left_anti")
        versions.merge_retrying(spark, root, rows, order=order, batch=(stream, number))

    return each


def stream_upserts(source: DataFrame, root: str, stream: str, checkpoint: str, **options) -> versions.Version:
    """Merge all that a streaming source holds, batch by batch; a call after a failure goes on where the last one ended."""
    run_available(source, upsert_batch(root, stream, **options), checkpoint)
    return versions.latest(source.sparkSession, root)


def changed_since(spark: SparkSession, root: str, number: int) -> DataFrame:
    """(id, change) of what a table's latest version has made of an earlier one."""
    return versions.changes(spark, versions.at(spark, root, number), versions.latest(spark, root)).select(F.col("id"), "change")
