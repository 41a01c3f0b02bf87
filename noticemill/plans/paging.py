"""Pages by key: borders of the listing, counted once, so that any page reads one range of (date, id)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..operators.versions import UNDATED, month_key
from ..stored import Scratch
from .listing import checked, newest_first

BLOCK = 10_000


@dataclass(frozen=True)
class Borders:
    """Every block-th row of a listing by its place: (place, data_publicacao, id), stored."""

    rows: DataFrame
    block: int


def borders(rows: DataFrame, block: int = BLOCK) -> Borders:
    """Borders of rows in the order of listings. Places are counted by ranges: no task sees all rows."""
    placed = numbered(rows.select("id", "data_publicacao"), *newest_first(), name="place")
    return Borders(Scratch(rows.sparkSession).keep(placed.where((F.col("place") - 1) % block == 0)), block)


def _from(row: Row) -> Column:
    """Rows at or after a border."""
    day, id = F.col("data_publicacao"), F.col("id") <= F.lit(row["id"])
    if row["data_publicacao"] is None:
        return day.isNull() & id
    given = F.lit(row["data_publicacao"])
    return day.isNull() | (day < given) | ((day == given) & id)


def _before(row: Row) -> Column:
    return ~F.coalesce(_from(row), F.lit(False))


def page_by_key(rows: DataFrame, given: Borders, number: int = 1, size: int = 20) -> DataFrame:
    """The rows of one page, as listing.page gives them, from the blocks that it lies in.

    rows are those that the borders were counted of. With a column mes, as in the stored table, months outside the range
    are not read. What is sorted are the rows of one block, or two where the page crosses a border.
    """
    checked(number, size)
    low, high = (number - 1) * size, number * size
    first = given.rows.where(F.col("place") <= low + 1).orderBy(F.desc("place")).limit(1).collect()
    after = given.rows.where(F.col("place") > high).orderBy("place").limit(1).collect()
    if not first:
        return rows.limit(0)
    held = rows.where(_from(first[0]))
    if after:
        held = held.where(_before(after[0]))
    if "mes" in rows.columns:
        month = lambda r: month_key(F.lit(r["data_publicacao"]).cast("date"))
        held = held.where((F.col("mes") <= month(first[0])) | (F.col("mes") == UNDATED))
        if after and after[0]["data_publicacao"] is not None:
            held = held.where(F.col("mes") >= month(after[0]))
    place = F.row_number().over(Window.orderBy(*newest_first())) + F.lit(first[0]["place"] - 1)  # of a block or two
    return held.withColumn("_place", place).where((F.col("_place") > low) & (F.col("_place") <= high)).orderBy("_place").drop("_place")
