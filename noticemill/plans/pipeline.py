"""The daily run: collect, prefilter, look up details, check again, classify, enrich, store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import analyse, looks_relevant, relevant, worth_details
from ..functions.text import collapse
from ..operators import versions
from ..operators.aggregate import run_counters
from ..operators.project import enriched, normalised, overlay, prefilter_text
from ..operators.store import already_in, append_new, insert_new, keep_first, not_in, upsert
from ..schema import STORED, align
from ..sources.notices import recent
from ..stored import Scratch

_READ = ("criterio_tipo", "criterio_resumo", "criterio_detalhe", "data_entrega_propostas")


@dataclass(frozen=True)
class Config:
    days: int = 7
    #: Column of the listing that tells the order in which it came; without one, rows go by their values.
    order: str | None = None


@dataclass(frozen=True)
class Run:
    """What a run leaves: the store, the checkpoint of all records found so far, one row of counters."""

    store: DataFrame
    checkpoint: DataFrame
    counters: DataFrame


def classified(df: DataFrame) -> DataFrame:
    """Stored notices, whose codes and kinds are joined texts, with their analysis by title and text."""
    kinds = F.split(F.coalesce("tipo_procedimento", F.lit("")), r"\s*;\s*")
    cpvs = F.split(F.coalesce("cpv", F.lit("")), r"\s*;\s*")
    return df.withColumn("analise", analyse(F.col("titulo"), F.col("texto"), cpvs, kinds))


def candidates(listing: DataFrame, as_of: Column, config: Config = Config()) -> DataFrame:
    """Recent raw records, the first of each id, that are worth looking up: those without id and those the prefilter rejects go."""
    rows = recent(listing, as_of, config.days, "drPublicationDate")
    rows = rows.where(F.coalesce(collapse(F.col("id")), F.lit("")) != "")
    if config.order:
        rows = keep_first(rows, ["id"], config.order)
    else:  # the row is its own place in the order, so that the aggregate holds it once
        least = rows.groupBy(F.col("id").alias("_id")).agg(F.min(F.struct(*sorted(rows.columns))).alias("_row"))
        rows = least.select(*(F.col(f"_row.`{c}`").alias(c) for c in rows.columns))
    return rows.where(worth_details(prefilter_text()))


def collect(listing: DataFrame, details: DataFrame, gazettes: DataFrame, checkpoint: DataFrame, as_of: Column, config: Config = Config()) -> DataFrame:
    """The checkpoint with the normalised records of what is new and still looks relevant with its details.

    Ids of the checkpoint are not looked up again, and its records win. gazettes (link_anuncio_dr, texto) say criteria and
    delivery dates of the records that refer to them.
    """
    seen = checkpoint.select(F.col("id_portal_base").alias("id"))
    whole = overlay(not_in(candidates(listing, as_of, config), seen, "id"), details)
    # the check reads codes and text as the record has them. Spark pushes no filter below a column that isn't
    # deterministic; below the projection it would make them a second time
    found = normalised(whole).withColumn("_settled", F.monotonically_increasing_id())
    found = found.where(looks_relevant(F.col("cpv"), F.col("texto")) & (F.col("_settled") >= 0)).drop("_settled")
    said = gazettes.dropDuplicates(["link_anuncio_dr"]).select("link_anuncio_dr", F.col("texto").alias("_said"))
    # read after the join, so that only documents of records that were found are
    read = enriched(found.join(said, "link_anuncio_dr", "left"), "_said").select(*found.columns, *_READ)
    return append_new(checkpoint, read, "id_portal_base")


def record_layout(df: DataFrame) -> DataFrame:
    """Raw records in the layout of a checkpoint."""
    return normalised(df).select("*", *(F.lit(None).cast("string").alias(c) for c in _READ))


def _judged(records: DataFrame) -> DataFrame:
    """With the part of the analysis that a run reads."""
    said = relevant(F.col("titulo"), F.col("texto"), F.col("cpvs"), F.col("tipos_contrato"))
    return records.withColumn("analise", F.struct(said.alias("relevante")))


def run(listing: DataFrame, details: DataFrame, gazettes: DataFrame, checkpoint: DataFrame, store: DataFrame, as_of: Column, config: Config = Config()) -> Run:
    """All records of the checkpoint are analysed, relevant ones inserted or, where the store has their link, laid over its rows.

    Records and whether they are relevant are stored, since several results read them.
    """
    keep = Scratch(listing.sparkSession).keep
    records = keep(collect(listing, details, gazettes, checkpoint, as_of, config))
    rows = keep(_judged(records))
    found = rows.where("analise.relevante")
    updated = upsert(align(store), already_in(found, store))
    return Run(insert_new(updated, not_in(found, store)), records, run_counters(rows, store))


@dataclass(frozen=True)
class TableRun:
    """What a run on the versioned table leaves: its version before and after, the checkpoint, counters and what has changed."""

    before: versions.Version
    after: versions.Version
    checkpoint: DataFrame
    counters: DataFrame
    changes: DataFrame


def run_table(listing: DataFrame, details: DataFrame, gazettes: DataFrame, checkpoint: DataFrame, root: str, as_of: Column, config: Config = Config()) -> TableRun:
    """The same on the versioned table in root: only the folders that relevant records touch are written.

    The table is joined by link without an exchange on its side, and the counters of rows that are really different come
    from the folders that the two versions don't share.
    """
    spark = listing.sparkSession
    keep = Scratch(spark).keep
    records = keep(collect(listing, details, gazettes, checkpoint, as_of, config))
    rows = keep(_judged(records))
    found = rows.where("analise.relevante").select(*(c for c in STORED.names if c in rows.columns))
    before = versions.latest(spark, root)
    after = versions.merge_retrying(spark, root, found)
    return TableRun(before, after, records, run_counters(rows, versions.read(spark, before)), versions.changes(spark, before, after))
