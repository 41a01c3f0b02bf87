"""Places of all rows in an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stored import Scratch

_ROW_BITS = 33  # of monotonically_increasing_id(): the row within its partition


def numbered(df: DataFrame, *order: Column, name: str = "posicao", parts: int | None = None) -> DataFrame:
    """Adds each row's place in the order, from 1.

    Rows are dealt by ranges of the order, sorted within, and stored with their place in their range; the ranges' sizes,
    as many rows as there are partitions, then give what comes before each. Rows that are equal in the order stand by the
    hash of their columns, and repeated rows by chance; both are split over ranges like others, so that a value that a
    third of all rows share does not end in one task.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = (F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.rand(7)) if df.columns else ()
    dealt = df.select("*", *(c.alias(f"_numbered_tie{i}") for i, c in enumerate(ties)))
    keys = [*order, *(F.col(f"_numbered_tie{i}") for i in range(len(ties)))]
    dealt = dealt.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(*(F.col(f"`{c}`") for c in df.columns), F.monotonically_increasing_id().alias("_numbered_at"))
    rows = Scratch(df.sparkSession).keep(dealt)
    part, within = F.shiftright("_numbered_at", _ROW_BITS), F.col("_numbered_at").bitwiseAND((1 << _ROW_BITS) - 1)
    sizes = rows.groupBy(part.alias("_numbered_part")).agg(F.count("*").alias("_numbered_size"))
    before = sizes.select("_numbered_part", (F.sum("_numbered_size").over(Window.orderBy("_numbered_part")) - F.col("_numbered_size")).alias("_numbered_before"))
    out = rows.withColumn("_numbered_part", part).join(F.broadcast(before), "_numbered_part")
    return out.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_numbered_before") + within + 1).alias(name))
