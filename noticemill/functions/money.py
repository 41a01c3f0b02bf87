"""Prices in local formats, and numbers of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

PRICE = "decimal(28,6)"


def parse_price(c: Column) -> Column:
    """Price of a text with comma or point as decimal mark; null if negative or none.

    With both marks the last one is decimal. One comma is decimal, more group thousands. Of points the last is decimal
    if one or two digits follow it, or the only point is followed by another number of digits than three.
    """
    plain = bound(F.regexp_replace(c, r"[^0-9,.\-]", ""), _plain)
    return F.regexp_extract(plain, "^[0-9]*[.]?[0-9]*$", 0).try_cast(PRICE)


def _plain(s: Column) -> Column:
    """Digits, marks and minus signs with a decimal point alone."""
    no = lambda x, mark: F.replace(x, F.lit(mark), F.lit(""))
    commas, points = F.length(s) - F.length(no(s, ",")), F.length(s) - F.length(no(s, "."))
    tail = F.length(F.substring_index(s, ".", -1))
    both = F.when(
        F.length(F.substring_index(s, ",", -1)) < tail, F.replace(no(s, "."), F.lit(","), F.lit("."))
    ).otherwise(no(s, ","))
    last_point = F.concat(no(F.substr(s, F.lit(1), F.length(s) - tail - 1), "."), F.lit("."), F.substring_index(s, ".", -1))
    return (
        F.when((commas > 0) & (points > 0), both)
        .when(commas == 1, F.replace(s, F.lit(","), F.lit(".")))
        .when(commas > 1, no(s, ","))
        .when(points > 1, F.when(tail.between(1, 2), last_point).otherwise(no(s, ".")))
        .when((points == 1) & (tail == 3), no(s, "."))
        .otherwise(s)
    )


def format_eur(d: Column, default: str | None = None) -> Column:
    """1.234,56 €, half to even."""
    text = F.concat(F.translate(F.format_number(d, 2), ",.", ".,"), F.lit(" €"))
    return F.coalesce(text, F.lit(default)) if default else text


def percent_change(now: Column, before: Column) -> Column:
    """Null where before is null or zero."""
    return F.try_divide((now - before) * F.lit(100.0), before)


def change_label(now: Column, before: Column) -> Column:
    """Signed percentage with one decimal; Novo where there was nothing before."""
    change = percent_change(now, before)
    text = F.concat(F.when(change > 0, "+").otherwise(""), F.replace(F.format_number(change, 1), F.lit(","), F.lit("")), F.lit("%"))
    return F.when(before == 0, F.when(now > 0, "Novo").otherwise("0%")).otherwise(text)


def bar_width(n: Column, most: Column) -> Column:
    return F.greatest(F.lit(8), F.bround(n * 100 / most).cast("int"))
