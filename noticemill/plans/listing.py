"""Listings: filter, sort, page, total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_or
from ..operators import filters as P
from ..operators.project import typed

COLUMNS = ["id", "titulo", "entidade", "link", "data_publicacao", "data_fim", "estado", "preco_base", "cpv", "tipo_procedimento"]


def selected(df: DataFrame, as_of: Column, period: str = "atual", search: str | None = None, entity: str | None = None, procedure: str | None = None, only_relevant: bool = False, state: str | None = None) -> DataFrame:
    """Rows of a period that all given filters accept, typed. Filters on stored columns come first and reach the scan."""
    rows = df.where(P.contains_text(search, "titulo", "entidade", "cpv")).where(P.contains_text(entity, "entidade")).where(P.contains_text(procedure, "tipo_procedimento"))
    if only_relevant:
        rows = rows.where(F.col("relevante") == 1)
    if "data_fim" in df.columns:  # a stored table
        return typed(rows.where(P.in_period_stored(period, as_of)), as_of).where(P.equals("estado", state))
    return typed(rows, as_of).where(P.in_period(period)).where(P.equals("estado", state))


def newest_first() -> tuple[Column, Column]:
    """Order of listings: latest publications first, undated last, ties by id, latest first."""
    return F.desc_nulls_last("data_publicacao"), F.desc("id")


def checked(number: int, size: int) -> None:
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page numbers begin at 1, sizes go from 1 to 100")


def page(df: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """The rows of one page, in the order of listings."""
    checked(number, size)
    return df.orderBy(*newest_first()).offset((number - 1) * size).limit(size)


def listing(df: DataFrame, as_of: Column, number: int = 1, size: int = 20, **filters) -> tuple[DataFrame, DataFrame]:
    """(page, one row with the total)."""
    rows = selected(df, as_of, **filters)
    # the entity's text comes before the page: a projection after limit would make the planner sort all rows
    named = rows.select(*(text_or(F.col(c), "Entidade não indicada").alias(c) if c == "entidade" else F.col(c) for c in COLUMNS))
    return page(named, number, size), rows.agg(F.count("*").alias("total"))


#: Columns of a notice by its id, in order.
RECORD = ["id", "titulo", "entidade", "link", "data", "relevante", "data_limite", "preco_base", "cpv", "tipo_procedimento"]


def by_id(df: DataFrame, id: int, *more: str) -> DataFrame:
    """The notice of an id, no row if there is none; more: columns behind the record's own."""
    return df.where(F.col("id") == id).select(*RECORD, *more)


def by_date(newest: bool = True, order: str = "id") -> tuple[Column, Column]:
    """Dashboard order; what can't be parsed counts as 1970."""
    key = F.coalesce("data_publicacao", F.lit("1970-01-01").cast("date"))
    return key.desc() if newest else key.asc(), F.col(order)


def sorted_by_date(df: DataFrame, newest: bool = True, order: str = "id") -> DataFrame:
    return df.orderBy(*by_date(newest, order))


def dashboard_counts(df: DataFrame, as_of: Column, delivery: Column) -> DataFrame:
    return df.agg(
        F.count("*").alias("todos"),
        *(F.count_if(P.statistic(k, as_of, delivery)).alias(k) for k in ("ativos", "novos", "terminam")),
        F.count_distinct(F.nullif(F.trim("entidade"), F.lit(""))).alias("entidades"),
    )
