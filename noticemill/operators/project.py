"""Projections: raw records to flat ones, detail over listing, typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.dates import deadline, formatted, parse_date, state
from ..functions.extract import award_criteria, cpv_entries, criteria_text, criteria_type, delivery_date
from ..functions.money import parse_price
from ..functions.text import blank_to_null, collapse, filled, joined, pstrip, search_form

#: Labels of a notice's full text, in order.
LABELS = {
    "Descrição": "titulo",
    "Entidade": "entidade",
    "Tipo de ato": "type",
    "Tipo de modelo": "modelType",
    "Tipo de contrato": "contractType",
    "Tipo de procedimento": "contractingProcedureType",
    "CPV": "cpv",
    "Preço base": "basePrice",
    "Prazo para propostas": "proposalDeadline",
    "Data de publicação": "drPublicationDate",
    "Número do anúncio": "announcementNumber",
}


#: Fields that may name the entity, in order.
ENTITY_FIELDS = ["contractingEntity", "entity", "entityName", "contractingEntityName"]


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*map(blank_to_null, columns))


def entity_name(entities: Column, *fallbacks: Column) -> Column:
    names = F.filter(F.transform(entities, lambda e: collapse(e["description"])), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(F.array_distinct(names), "; "), F.lit("")), *map(blank_to_null, fallbacks))


def empty_to_null(df: DataFrame, name: str) -> Column:
    """Null for an empty text or list; zero and false stay."""
    kind = df.schema[name].dataType
    if isinstance(kind, StringType):
        return F.nullif(df[name], F.lit(""))
    if isinstance(kind, ArrayType):
        return F.when(F.size(df[name]) > 0, df[name])
    return df[name]


def last_given(values: dict[str, Column], order: str | None, columns: list[str]) -> list[Column]:
    """Aggregates: of each value the last that isn't null, in order of a column, else of the rows' values."""
    place = F.col(order) if order else F.struct(*sorted(columns))
    return [F.max_by(v, F.when(v.isNotNull(), place)).alias(name) for name, v in values.items()]


def overlay(listing: DataFrame, detail: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Left join; a detail's value wins unless it is null or empty.

    Several details for a key are laid over each other in order of a column, or else of their own values.
    """
    shared = [c for c in detail.columns if c in listing.columns and c != key]
    own = detail.groupBy(F.col(key).alias("_key")).agg(*last_given({f"_{c}": empty_to_null(detail, c) for c in shared}, order, detail.columns))
    out = listing.join(own, F.col(key) == F.col("_key"), "left")
    return out.select(*((F.coalesce(F.col(f"_{c}"), F.col(c)) if c in shared else F.col(c)).alias(c) for c in listing.columns))


def full_text(df: DataFrame) -> Column:
    """`Label: value` lines of the fields that are filled."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), filled(collapse(F.col(c))))
    return F.concat_ws("\n", *(line(label, c) for label, c in LABELS.items() if c in df.columns))


def normalised(raw: DataFrame, portal: str = "https://portal.example.org/detalhe/") -> DataFrame:
    """Raw listing records as flat notices."""
    # what several columns are made of comes in a projection of its own, so that it is computed once
    kinds, cpvs = F.col("_kinds"), F.col("_cpvs")
    read = raw.select(
        "*",
        cpv_entries(F.col("cpvs")).alias("_cpvs"),
        F.array(*(collapse(F.col(c)) for c in ("contractType", "contractingProcedureType", "modelType", "type"))).alias("_kinds"),
    )
    flat = read.select(
        "*",
        first_filled(F.col("contractDesignation"), F.col("description")).alias("titulo"),
        entity_name(F.col("contractingEntities"), *map(F.col, ENTITY_FIELDS)).alias("entidade"),
        F.array_join(cpvs, "; ").alias("cpv"),
    )
    return flat.select(
        F.col("id").alias("id_portal_base"),
        F.coalesce("titulo", F.lit("Sem título")).alias("titulo"),
        "entidade",
        F.concat(F.lit(portal + "?type=anuncios&id="), F.url_encode("id")).alias("link"),
        formatted(F.col("drPublicationDate")).alias("data"),
        F.nullif(formatted(F.col("proposalDeadline")), F.lit("")).alias("data_limite"),
        blank_to_null(F.col("basePrice")).alias("preco_base"),
        cpvs.alias("cpvs"),
        "cpv",
        F.array_distinct(F.filter(kinds, lambda x: x != "")).alias("tipos_contrato"),
        joined(F.array_distinct(kinds), "; ").alias("tipo_procedimento"),
        F.coalesce(blank_to_null(F.col("announcementNumber")), collapse(F.col("id"))).alias("numero_anuncio"),
        blank_to_null(F.col("reference")).alias("link_anuncio_dr"),
        blank_to_null(F.col("contractingProcedureUrl")).alias("link_pecas"),
        blank_to_null(F.col("contractingProcedureId")).alias("id_procedimento"),
        full_text(flat).alias("texto"),
    )


#: Fields of a raw record that the prefilter reads, in order.
PREFILTERED = ["contractDesignation", "description", "contractingEntity", "contractingProcedureType", "contractType", "modelType", "type"]


def prefilter_text() -> Column:
    """What the prefilter reads of a raw record, in search form."""
    return search_form(F.concat_ws(" ", *PREFILTERED))


def flat_text(raw: DataFrame) -> DataFrame:
    """Adds texto, the full text, and cpv, the joined codes, to raw records, for the check after details are laid over."""
    cpv = F.array_join(cpv_entries(F.col("cpvs")), "; ")
    title = first_filled(F.col("contractDesignation"), F.col("description"))
    entity = entity_name(F.col("contractingEntities"), *map(F.col, ENTITY_FIELDS))
    named = raw.select("*", title.alias("titulo"), entity.alias("entidade"), cpv.alias("cpv"))
    return named.select(*raw.columns, "cpv", full_text(named).alias("texto"))


def typed(df: DataFrame, as_of: Column) -> DataFrame:
    """Adds data_publicacao, data_fim, estado, preco: what filters and aggregates read. Those that are stored with the rows are taken."""
    out = df
    if "data_publicacao" not in df.columns:
        out = out.withColumn("data_publicacao", parse_date(F.col("data")))
    if "preco" not in df.columns:
        out = out.withColumn("preco", parse_price(F.col("preco_base")))
    if "data_fim" not in df.columns:
        out = out.withColumn("data_fim", deadline(F.col("data_publicacao"), F.col("data_limite")))
    return out.withColumn("estado", state(F.col("data_fim"), as_of))


def enriched(df: DataFrame, text: str = "texto") -> DataFrame:
    """Adds criteria and delivery date read out of a document's text."""
    out = df.withColumn("criterios", award_criteria(F.col(text)))
    return out.select(
        "*",
        criteria_type(F.col("criterios")).alias("criterio_tipo"),
        criteria_text(F.col("criterios")).alias("criterio_resumo"),
        criteria_text(F.col("criterios"), "\n").alias("criterio_detalhe"),
        delivery_date(F.col(text)).alias("data_entrega_propostas"),
    )


def location(municipality: Column, district: Column, entity: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (municipality, district, entity)), F.lit("Portugal"))


def stripped_title(c: Column) -> Column:
    return pstrip(c)
