"""Dates: lenient parsers by profile, deadlines, states, calendar months, badges. All take an explicit as_of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import MONTHS
from .text import bound, collapse, pstrip

_ISO = "yyyy-M-d"
_DAY_FIRST = (r"^([0-9]{1,2})([-/])([0-9]{1,2})\2([0-9]{4})$", "$4-$3-$1")
_CLOCK = r"([01]?[0-9]|2[0-3]):[0-5]?[0-9](:[0-5]?[0-9])"
_FRACTION = r"(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?"
_ISO_TIME = (rf"^([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}})[T ]{_CLOCK}$", "$1")
_ISO_FRACTION = (rf"^([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}})[T ]{_CLOCK}{_FRACTION}$", "$1")
_DAY_FIRST_TIME = (rf"^([0-9]{{1,2}})([-/])([0-9]{{1,2}})\2([0-9]{{4}}) +{_CLOCK}?$", "$4-$3-$1")
_OTHERWISE = r"(?s)^(?![0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$).*?"
_DAY_FIRST_INSIDE = (_OTHERWISE + r"(?<![0-9])([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})(?![0-9]).*$", "$3-$2-$1")
_ISO_INSIDE = (_OTHERWISE + r"([0-9]{4}-[0-9]{2}-[0-9]{2}).*$", "$1")
#: Accepted forms, each rewritten as year-month-day, so that an expression reads its text once and parses one format.
PROFILES: dict[str, list[tuple[str, str]]] = {
    "listing": [_DAY_FIRST, _ISO_TIME],
    "store": [_DAY_FIRST, _ISO_FRACTION, _DAY_FIRST_TIME],
    "collector": [_DAY_FIRST, _ISO_FRACTION, _DAY_FIRST_INSIDE],
    "monthly": [_DAY_FIRST, _ISO_FRACTION, _DAY_FIRST_TIME, _ISO_INSIDE],
    "deadline": [_DAY_FIRST, _ISO_TIME, _DAY_FIRST_TIME],
}


def parse_date(c: Column, profile: str = "listing") -> Column:
    """The date, or null. Only the listing and deadline profiles refuse fractions of seconds and zones after a time."""
    text = pstrip(c)
    for pattern, iso in PROFILES[profile]:
        text = F.regexp_replace(text, pattern, iso)
    return F.try_to_date(text, _ISO)


def deadline(published: Column, limit: Column) -> Column:
    """End of the period: an absolute date, with or without time, or so many calendar days after publication.

    Each text is bound, so that a filter which is pushed below the notices' own expressions reads it once.
    """
    days = bound(F.regexp_extract(limit, "([0-9]+)", 1).try_cast("int"), lambda n: F.nullif(n, F.lit(0)))
    return bound(published, lambda p: F.when(p.isNotNull(), F.coalesce(parse_date(limit, "deadline"), F.date_add(p, days))))


def state(end: Column, as_of: Column) -> Column:
    """Through a map, so that the expression for the end is there once."""
    names = F.create_map(F.lit(True), F.lit("aberto"), F.lit(False), F.lit("encerrado"))
    return F.coalesce(F.element_at(names, end >= as_of), F.lit("sem_prazo"))


def dashboard_date(c: Column) -> Column:
    """A text that begins as YYYY-MM-DD or as D-M-YYYY with - / or . between; months and days beyond their range carry over."""

    def read(t: Column) -> Column:
        part = lambda pattern, group: F.regexp_extract(t, pattern, group).try_cast("int")
        iso, local = "^([0-9]{4})-([0-9]{2})-([0-9]{2})", "^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})"
        year, month, day = (F.coalesce(part(iso, i), part(local, j)) for i, j in ((1, 3), (2, 2), (3, 1)))
        year = F.when(year < 100, year + 1900).otherwise(year)
        return F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1)

    return bound(pstrip(c), read)


def formatted(c: Column) -> Column:
    """dd-MM-yyyy where a date is found, else the text with white space collapsed."""
    return F.coalesce(F.date_format(parse_date(c, "collector"), "dd-MM-yyyy"), collapse(c))


def month_start(d: Column) -> Column:
    return F.trunc(d, "MM").cast("date")


def month_window(as_of: Column, back: int = 0) -> tuple[Column, Column]:
    """First day of the month back months before as_of's, and of the month after it."""
    return F.add_months(month_start(as_of), -back), F.add_months(month_start(as_of), 1 - back)


def month_name(d: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d))


def delivery_time(c: Column, default_time: str = "00:00") -> Column:
    """Timestamp of a text that begins with DD-MM-YYYY and perhaps HH:MM."""
    day = F.regexp_extract(c, "^([0-9]{2}-[0-9]{2}-[0-9]{4})", 1)
    time = F.regexp_extract(c, "^[0-9]{2}-[0-9]{2}-[0-9]{4} +([0-9]{2}:[0-9]{2})", 1)
    return F.try_to_timestamp(F.concat_ws(" ", day, F.when(time == "", default_time).otherwise(time)), F.lit("dd-MM-yyyy HH:mm"))


def days_left(until: Column, as_of: Column) -> Column:
    """Whole days from the start of as_of, begun ones counting."""
    return F.ceil((F.unix_timestamp(until) - F.unix_timestamp(as_of.cast("timestamp"))) / 86400).cast("int")


def days_left_label(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("Faltam "), n.cast("string"), F.lit(" dias"))).when(n.isNotNull(), "Prazo terminado")


def freshness(published: Column, as_of: Column) -> Column:
    n = F.datediff(as_of, published)
    return F.when(n <= 0, "Hoje").when(n == 1, "Ontem").when(n <= 7, F.concat(n.cast("string"), F.lit(" dias")))


#: Shown where there is no date.
NO_DATE = "Sem data"


def _shown(c: Column, form: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(NO_DATE)).otherwise(F.coalesce(form, c))


def display_date(c: Column) -> Column:
    """Three parts between hyphens the other way round, with slashes; other texts as they are."""
    parts = F.split(c, "-", -1)
    return _shown(c, F.when(F.size(parts) == 3, F.array_join(F.reverse(parts), "/")))


def display_delivery(c: Column) -> Column:
    """DD/MM/YYYY and perhaps HH:MM of a text that begins as DD-MM-YYYY; other texts as they are."""
    pattern = r"(?U)^([0-9]{2})-([0-9]{2})-([0-9]{4})(?:\s+([0-9]{2}:[0-9]{2}))?"
    part = lambda i: F.regexp_extract(c, pattern, i)
    return _shown(c, F.when(part(1) != "", F.rtrim(F.concat(part(1), F.lit("/"), part(2), F.lit("/"), part(3), F.lit(" "), part(4)))))


def display_history(c: Column) -> Column:
    """DD/MM/YYYY of a text that begins as YYYY-MM-DD and names a day; other texts as they are."""
    return _shown(c, F.date_format(F.try_to_date(F.regexp_extract(c, "^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:$|[T ])", 1), "yyyy-MM-dd"), "dd/MM/yyyy"))
