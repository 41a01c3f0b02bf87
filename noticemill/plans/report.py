"""Monthly summary and month comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_name, month_window
from ..functions.money import change_label, percent_change
from ..operators.aggregate import two_periods
from ..operators.filters import published_between


def oldest_first() -> tuple[Column, Column]:
    """Order of a period's list."""
    return F.col("data_publicacao"), F.coalesce(F.col("titulo"), F.lit(""))


def period_list(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows published in [start, end), oldest first, then by title."""
    return df.where(published_between(start, end)).orderBy(*oldest_first())


def monthly_summary(df: DataFrame, as_of: Column) -> DataFrame:
    """Rows of the month before as_of's."""
    return period_list(df, *month_window(as_of, 1))


def month_comparison(df: DataFrame, as_of: Column, back: int = 0) -> DataFrame:
    """One row: a month against the month before it, with changes as numbers and labels."""
    out = two_periods(df, month_window(as_of, back), month_window(as_of, back + 1))
    return out.select(
        month_name(month_window(as_of, back)[0]).alias("mes"),
        "*",
        percent_change(F.col("atual"), F.col("anterior")).cast("double").alias("variacao"),
        change_label(F.col("atual"), F.col("anterior")).alias("variacao_texto"),
    )
