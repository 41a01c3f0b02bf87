"""What is read out of free text: award criteria, delivery dates, classification codes, ids in links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, bound, clean_text, collapse, filled, fold, pstrip

#: The labels of a notice's document.
CRITERION = r"(?isu)Nome:\s*(.*?)\s+Ponderação:\s*([0-9]{1,3})%"
OLD_CRITERION = r"(?iu)([A-Za-zÀ-ÿ\s\-/]+?)\s*[:\-]\s*([0-9]{1,3})\s*%"
DELIVERY_LABELS = ["Prazo para apresentação das propostas", "Data limite para apresentação das propostas"]
CODE = r"\b([0-9]{8})(?:-[0-9])?\b"


def _criteria(text: Column, pattern: str) -> Column:
    names = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), collapse)
    return F.zip_with(names, F.regexp_extract_all(text, F.lit(pattern), 2), lambda n, p: F.struct(n.alias("nome"), p.try_cast("int").alias("peso")))


def award_criteria(text: Column) -> Column:
    """Distinct (nome, peso) in order of appearance; older documents without name labels are read by `name: NN%`."""

    def read(t: Column) -> Column:
        labelled = F.filter(_criteria(t, CRITERION), lambda x: x["nome"] != "")
        other = F.filter(
            _criteria(t, OLD_CRITERION),
            lambda x: ~F.lower(x["nome"]).rlike("pondera(ção|cao)") & (F.length(x["nome"]) <= 80),
        )
        return bound(labelled, lambda found: F.when(F.size(found) > 0, found).otherwise(other))

    return F.array_distinct(bound(clean_text(text), read))


def criteria_type(criteria: Column) -> Column:
    return F.when(F.size(criteria) == 1, "Monofator").when(F.size(criteria) > 1, "Multifator")


def criteria_text(criteria: Column, separator: str = " • ") -> Column:
    parts = F.transform(criteria, lambda x: F.concat(x["nome"], F.lit(" "), x["peso"].cast("string"), F.lit("%")))
    return F.nullif(F.array_join(parts, separator), F.lit(""))


def delivery_date(text: Column) -> Column:
    """DD-MM-YYYY, with HH:MM if it is there, after the first label that has one; null if none."""

    def after(label: str) -> Column:
        # the text is searched once, for day and time together
        said = F.regexp_extract(text, rf"(?iu){label}\s*[:\-]?\s*([0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}(?:\s+[0-9]{{2}}:[0-9]{{2}})?)", 1)
        return filled(F.regexp_replace(said, r"\s+", " "))

    return F.coalesce(*map(after, DELIVERY_LABELS))


def percentage(text: Column) -> Column:
    """First percentage, comma as point, `.0` dropped; null if none."""
    found = F.replace(F.regexp_extract(text, r"(?U)(\d+(?:[.,]\d+)?)\s*%", 1), F.lit(","), F.lit("."))
    return F.when(found != "", F.concat(F.regexp_replace(found, r"\.0$", ""), F.lit("%")))


def criteria_section(text: Column, most: int = 100) -> Column:
    """Lines from the heading of the award criteria to the next heading with a greater number; empty if none."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    heading = F.transform(lines, lambda x: fold(F.lower(x), compat=True).rlike(r"criterios?\s+de\s+adjudicacao"))
    whole = F.struct(lines.alias("lines"), F.array_position(heading, True).cast("int").alias("at"))
    section = F.get(F.transform(F.array(whole), lambda s: _section(s["lines"], s["at"], most)), F.lit(0))
    return pstrip(F.coalesce(section, F.lit("")))


def _section(lines: Column, at: Column, most: int) -> Column:
    number = lambda x, more: F.nullif(F.regexp_extract(x, rf"^\s*([0-9]+)\s*[-–—.]{more}", 1), F.lit("")).try_cast("int")
    own = number(F.get(lines, at - 1), "")
    rest = F.slice(lines, at + 1, F.lit(most - 1))
    ends = F.transform(rest, lambda x: F.coalesce(number(pstrip(x), r"\s+\S") > F.coalesce(own, F.lit(-1)), F.lit(False)))
    end = F.array_position(ends, True).cast("int")
    kept = F.when(end > 0, F.slice(rest, F.lit(1), end - 1)).otherwise(rest)
    return F.when(at > 0, F.array_join(F.concat(F.slice(lines, at, F.lit(1)), kept), "\n"))


#: Labels of factors and weights.
_NAME_LABEL = r"(?i)^\s*(?:nome|designacao|fator|factor)\s*:\s*"
_WEIGHT_LABEL = r"(?i)^\s*(?:ponderacao|peso|percentagem)\s*:\s*"
_NO_FACTOR = r"^(?:[0-9]+\s*[-–—.]?\s*criterios?\s+de\s+adjudicacao|multifator|monofator|sim|nao)\s*:?\s*(?:sim|nao)?\s*$"


def factor_name(text: Column) -> Column:
    """Without its label and punctuation around it."""
    return F.regexp_replace(collapse(F.regexp_replace(text, _NAME_LABEL, "")), r"^[ :\-–—.;]+|[ :\-–—.;]+$", "")


def factors(section: Column) -> Column:
    """Distinct (nome, peso) of a section's lines: a weight belongs to the name on its line, else to the last name before it."""
    lines = F.filter(F.transform(F.split(section, "\n"), clean_text), lambda x: x != "")
    lines = F.filter(lines, lambda x: ~fold(F.lower(x), compat=True).rlike(_NO_FACTOR))

    def read(x: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(x, r"[0-9]+(?:[.,][0-9]+)?\s*%", ""), _WEIGHT_LABEL, "")
        named = x.rlike(_NAME_LABEL + r"\S") | (~x.rlike(_WEIGHT_LABEL) & (F.length(x) <= 100))
        return F.struct(percentage(x).alias("peso"), factor_name(bare).alias("own"), F.when(named, factor_name(x)).alias("name"))

    pair = "struct<nome:string,peso:string>"
    start = F.struct(F.lit("").alias("pending"), F.array().cast(f"array<{pair}>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        name = F.coalesce(F.nullif(x["own"], F.lit("")), acc["pending"])
        taken = x["peso"].isNotNull() & (name != "")
        found = F.when(taken, F.array_append(acc["found"], F.struct(name.alias("nome"), x["peso"].alias("peso")))).otherwise(acc["found"])
        pending = F.when(taken, F.lit("")).when(x["peso"].isNotNull(), acc["pending"]).otherwise(F.coalesce(x["name"], acc["pending"]))
        return F.struct(pending.alias("pending"), found.alias("found"))

    return F.array_distinct(F.aggregate(F.transform(lines, read), start, step, lambda acc: acc["found"]))


def cpv_codes(text: Column) -> Column:
    """Eight-digit codes, their check digit dropped."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CODE), 1)


def has_cpv(text: Column, families: tuple[str, ...] = ("712", "714")) -> Column:
    return F.exists(cpv_codes(text), lambda c: c.rlike(f"^({'|'.join(families)})"))


def cpv_list(text: Column) -> Column:
    """Parts between semicolons or bars, blank ones dropped, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"\s*[;|]\s*"), pstrip), lambda x: x != ""))


def cpv_entry(x: Column) -> Column:
    """`code, description` of an entry that is a JSON object, else its text."""
    part = lambda *keys: filled(collapse(F.coalesce(*(filled(F.get_json_object(x, f"$.{k}")) for k in keys))))
    return F.when(F.startswith(F.ltrim(x), F.lit("{")), F.concat_ws(", ", part("code", "cpv", "id"), part("description", "name"))).otherwise(collapse(x))


def cpv_entries(cpvs: Column) -> Column:
    """Distinct texts of entries, blank ones dropped; none for null."""
    texts = F.transform(F.coalesce(cpvs, F.array().cast("array<string>")), cpv_entry)
    return F.array_distinct(F.filter(texts, lambda x: x != ""))


def in_cpv_family(cpvs: Column, family: str = "712") -> Column:
    """Whether the digits of any entry begin with the family."""
    return F.exists(F.transform(cpvs, lambda x: F.regexp_replace(x, "[^0-9]", "")), lambda c: F.startswith(c, F.lit(family)))


def url_parameter(link: Column, name: str) -> Column:
    return F.try_parse_url(pstrip(link), F.lit("QUERY"), F.lit(name))


def portal_id(link: Column) -> Column:
    return blank_to_null(url_parameter(link, "id"))


def detail_link(base: str, id: Column) -> Column:
    return F.when(F.coalesce(pstrip(id), F.lit("")) == "", F.lit(base)).otherwise(F.concat(F.lit(f"{base}?type=anuncios&id="), F.url_encode(id)))
