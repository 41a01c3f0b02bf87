"""Rule classifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as L
from .extract import has_cpv, in_cpv_family
from .phrases import any_indexed, indexed_lists
from .text import any_phrase, bound, classify_form, fold, phrases, search_form


def _forms(kinds: Column) -> Column:
    return F.transform(F.filter(kinds, lambda k: k.isNotNull()), classify_form)


def _any_of_kind(forms: Column, words: list[str]) -> Column:
    return F.coalesce(F.exists(forms, lambda k: F.exists(phrases(words), lambda w: F.contains(k, w))), F.lit(False))


def analyse(title: Column, text: Column, cpvs: Column, kinds: Column) -> Column:
    """Struct of a notice's relevance for architecture, with matches, exclusions and reasons."""
    whole = classify_form(F.concat_ws(" ", title, text))
    lists = {"explicit": L.EXPLICIT, "action": L.DESIGN_ACTION, "coordination": L.COORDINATION, "exclusion": L.EXCLUSION, "supervision": L.SUPERVISION, "engineering": L.ENGINEERING}
    found = lambda k: F.struct(
        *(k["lists"][n].alias(n) for n in lists),
        _any_of_kind(k["forms"], L.SERVICE_CONTRACTS).alias("service"),
        _any_of_kind(k["forms"], L.WORKS_CONTRACTS).alias("works"),
        F.coalesce(in_cpv_family(cpvs), F.lit(False)).alias("cpv"),
    )
    return bound(bound(F.struct(indexed_lists(whole, lists).alias("lists"), _forms(kinds).alias("forms")), found), _decide)


def relevant(title: Column, text: Column, cpvs: Column, kinds: Column) -> Column:
    """What analyse() says of relevance alone: nothing more is looked for once that is decided."""

    def decide(t: Column) -> Column:
        some = lambda *lists: any_indexed(t, [w for words in lists for w in words])
        by_cpv = F.coalesce(in_cpv_family(cpvs), F.lit(False)) & some(L.DESIGN_ACTION, L.COORDINATION)
        clear = ~some(L.EXCLUSION, L.SUPERVISION)
        return bound(some(L.EXPLICIT), lambda explicit: (explicit | (by_cpv & ~some(L.ENGINEERING))) & clear)

    whole = classify_form(F.concat_ws(" ", title, text))
    return _any_of_kind(_forms(kinds), L.SERVICE_CONTRACTS) & bound(whole, decide)


def _decide(m: Column) -> Column:
    some = lambda n: F.size(m[n]) > 0
    by_cpv = m["cpv"] & (some("action") | some("coordination"))
    blocked = some("exclusion") | some("supervision")
    isolated = some("engineering") & ~some("explicit")
    relevant = m["service"] & (some("explicit") | by_cpv) & ~blocked & ~isolated
    holds = {"service": m["service"], "explicit": some("explicit"), "by_cpv": by_cpv, "coordination": some("coordination"), "blocked": blocked, "engineering": isolated}
    none = F.array().cast("array<string>")
    return F.struct(
        relevant.alias("relevante"),
        m["service"].alias("aquisicao_servicos"),
        m["works"].alias("empreitada"),
        m["cpv"].alias("cpv_712"),
        F.array_distinct(F.concat(m["explicit"], m["action"], m["coordination"])).alias("correspondencias"),
        F.array_distinct(F.concat(m["exclusion"], m["supervision"], F.when(isolated, m["engineering"]).otherwise(none))).alias("exclusoes"),
        F.filter(F.array(*(F.when(c, F.lit(L.REASONS[k])) for k, c in holds.items())), lambda x: x.isNotNull()).alias("motivos"),
    )


def worth_details(text: Column) -> Column:
    """Prefilter before details are looked up; text in search form."""
    return bound(text, lambda t: _worth(t) | any_indexed(t, L.COMPETITION_WORDS))


def _worth(t: Column) -> Column:
    return any_indexed(t, L.STRONG_WORDS) | any_indexed(t, L.PROJECT_WORDS) | (any_indexed(t, L.BUILDING_WORDS) & any_indexed(t, L.SERVICE_WORDS))


def looks_relevant(cpv: Column, text: Column) -> Column:
    return has_cpv(cpv) | bound(search_form(text), _worth)


def _first_match(text: Column, table: dict[str, list[str]], other: str | None) -> Column:
    def first(t: Column) -> Column:
        out = F
        for name, words in table.items():
            out = out.when(any_phrase(t, words), name)
        return out.otherwise(F.lit(other))

    return bound(text, first)


def category(title: Column) -> Column:
    return _first_match(F.lower(F.coalesce(title, F.lit(""))), L.CATEGORIES, L.OTHER_CATEGORY)


def badge(title: Column) -> Column:
    return _first_match(F.lower(F.coalesce(title, F.lit(""))), L.BADGES, L.OTHER_BADGE)


def service(title: Column, procedure: Column) -> Column:
    return _first_match(F.lower(fold(F.concat_ws(" ", title, procedure))), L.SERVICES, None)


def weighted_score(text: Column) -> Column:
    """Sum of the weights of the phrases in a text; PASS_SCORE passes."""
    table = F.array(*(F.struct(F.lit(k).alias("w"), F.lit(v).alias("n")) for k, v in L.WEIGHTS.items()))
    low = F.lower(F.coalesce(text, F.lit("")))
    return bound(low, lambda t: F.aggregate(table, F.lit(0), lambda a, x: a + F.when(F.contains(t, x["w"]), x["n"]).otherwise(0)))


def state_label(state: Column) -> Column:
    return F.when(state == "aberto", "Aberto").when(state == "encerrado", "Encerrado").otherwise("Sem prazo")
