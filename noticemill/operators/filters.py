"""Predicates of listings and of the dashboard."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import any_phrase, fold

ALL = ("todos", "Todos", "Todos os distritos", None, "")
#: What the dashboard searches, in order.
SEARCHED = ["titulo", "entidade", "distrito", "municipio", "preco_base"]


def in_period(period: str) -> Column:
    """atual: not closed; historico: closed."""
    return F.col("estado") != "encerrado" if period == "atual" else F.col("estado") == "encerrado"


def in_period_stored(period: str, as_of: Column) -> Column:
    """The same by the stored end of the period, so that the scan skips what lies outside."""
    end = F.col("data_fim")
    return end.isNull() | (end >= as_of) if period == "atual" else end < as_of


def in_period_by_year(published: Column, as_of: Column, period: str) -> Column:
    return F.year(published) == F.year(as_of) if period == "atual" else F.year(published) < F.year(as_of)


def equals(column: str, value: str | None) -> Column:
    return F.lit(True) if value in ALL else F.col(column) == value


def contains_text(term: str | None, *columns: str) -> Column:
    """Literal substring of any of the columns, case not counting."""
    term = (term or "").strip().lower()
    if not term:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(term))
    return out


def like_text(term: str, *columns: str) -> Column:
    """SQL LIKE with % and _ as wildcards, only A-Z folded."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = "%" + term.translate(str.maketrans(upper, lower)) + "%"
    out = F.lit(False)
    for c in columns:
        out = out | F.translate(F.coalesce(c, F.lit("")), upper, lower).like(pattern)
    return out


def dashboard_search(term: str, *columns: str) -> Column:
    parts = [F.nullif(c if isinstance(c, Column) else F.col(c), F.lit("")) for c in columns]
    return F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(term.strip().lower()))


def published_between(start: Column, end: Column, column: str = "data_publicacao") -> Column:
    return (F.col(column) >= start) & (F.col(column) < end)


def published_last_week(as_of: Column, column: str = "data_publicacao") -> Column:
    return F.col(column).between(F.date_sub(as_of, 6), as_of)


def ending_within_week(as_of: Column, when: Column) -> Column:
    return F.to_date(when).between(as_of, F.date_add(as_of, 7))


def any_procedure(selected: list[str], column: str = "tipo_procedimento") -> Column:
    if not selected:
        return F.lit(True)
    wanted = ["".join(x for x in unicodedata.normalize("NFD", p) if not "\u0300" <= x <= "\u036f").lower() for p in selected]
    return any_phrase(F.lower(fold(F.coalesce(column, F.lit("")))), wanted)


def any_service(service: Column, selected: list[str]) -> Column:
    return F.coalesce(service.isin(selected), F.lit(False)) if selected else F.lit(True)


def filled(column: str) -> Column:
    return F.col(column).isNotNull() & (F.trim(column) != "")


def with_criteria() -> Column:
    """Rows whose criteria can be cleaned."""
    return F.col("criterio_resumo").isNotNull()


def with_weight_as_name() -> Column:
    """Rows in which the label of the weights was taken for a criterion; only A-Z folded, as LIKE does."""
    return F.translate("criterio_resumo", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").like("ponderação%")


def dashboard(as_of: Column, delivery: Column, service: Column, search: str = "", category: tuple[Column, str] | None = None, district: tuple[Column, str] | None = None, procedures: list[str] = (), services: list[str] = (), kind: str = "todos") -> Column:
    """All filters of the dashboard at once."""
    out = dashboard_search(search, *SEARCHED)
    for chosen in (category, district):
        if chosen and chosen[1] not in ALL:
            out = out & (chosen[0] == chosen[1])
    return out & any_procedure(list(procedures)) & any_service(service, list(services)) & statistic(kind, as_of, delivery)


def simple_list(search: str, state: str | None) -> Column:
    return contains_text(search, "titulo", "entidade") & equals("estado", state)


def statistic(kind: str, as_of: Column, delivery: Column) -> Column:
    """One of todos, ativos, novos, terminam, entidades."""
    return {
        "todos": F.lit(True),
        "ativos": F.col("estado") == "aberto",
        "novos": published_last_week(as_of),
        "terminam": ending_within_week(as_of, delivery),
        "entidades": filled("entidade"),
    }[kind]
