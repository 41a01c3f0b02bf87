"""Landed pages of a listing, newest first: read up to the first page that holds an older row, and no further."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.dates import parse_date
from ..operators.numbering import numbered

PUBLISHED = "drPublicationDate"


def land_pages(raw: DataFrame, root: str, size: int = 25) -> None:
    """Raw records as pages, one folder each: latest publications first, undated before them, position in the listing kept."""
    published = parse_date(F.col(PUBLISHED), "collector")
    placed = numbered(raw, F.desc_nulls_first(published), F.col("id"), name="position")
    pages = placed.withColumn("page", F.floor((F.col("position") - 1) / size).cast("int") + 1)
    pages.repartition("page").sortWithinPartitions("page", "position").write.partitionBy("page").json(root)


def pages_needed(pages: DataFrame, oldest: Column, size: int = 25, first: int = 4, most: int | None = None) -> int:
    """The number of the page to stop at: the first that is short or holds a row published before oldest.

    Looks at so many pages first, then at four times as many more each time, so that the pages looked at are in proportion
    to those needed; the others are pruned by their number. most ends the search as a limit of requests would.
    """
    before, upto = 0, first
    older = F.count_if(parse_date(F.col(PUBLISHED), "collector") < oldest)
    while True:
        upto = min(upto, most) if most else upto
        looked = pages.where((F.col("page") > before) & (F.col("page") <= upto)).groupBy("page").agg(F.count("*").alias("n"), older.alias("older"))
        seen = looked.agg(F.count("*").alias("pages"), F.min(F.when((F.col("older") > 0) | (F.col("n") < size), F.col("page"))).alias("stop")).first()
        if seen["stop"] is not None:
            return seen["stop"]
        if seen["pages"] < upto - before or upto == most:  # no more pages
            return before + seen["pages"]
        before, upto = upto, upto + 4 * (upto - before)


def read_recent(spark: SparkSession, root: str, schema: StructType, as_of: Column, days: int = 7, size: int = 25, most: int | None = None) -> DataFrame:
    """Records of landed pages that were published in the last days or have no date, with position and page."""
    pages = spark.read.schema(StructType(schema.fields).add("position", "long").add("page", "integer")).json(root)
    oldest = F.date_sub(as_of, days)
    stop = pages_needed(pages, oldest, size, most=most)
    published = parse_date(F.col(PUBLISHED), "collector")
    return pages.where((F.col("page") <= stop) & (published.isNull() | (published >= oldest)))
