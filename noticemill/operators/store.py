"""The keyed store: immutable Parquet snapshots, insert of new links, coalescing upsert, backlog."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, dedup_bullets
from ..schema import ENRICHED, STORED, align
from ..stored import CommitConflict, create_once
from .filters import with_criteria
from .project import enriched, last_given


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by a column that tells rows apart; rows with a blank key all stay. Aggregated partially."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.coalesce(F.trim(F.col(k).cast("string")) == "", F.lit(True))
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)))
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.when(blank, F.col(order)).alias("_own"), F.struct(F.col(order)).alias("_order"), row.alias("_row"))
    first = rows.groupBy(*names, "_own").agg(F.min_by("_row", "_order").alias("_row"))
    return first.select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(df.columns)))


def not_in(df: DataFrame, store: DataFrame, key: str = "link") -> DataFrame:
    return df.join(store.select(key), key, "left_anti")


def already_in(df: DataFrame, store: DataFrame, key: str = "link") -> DataFrame:
    return df.join(store.select(key), key, "left_semi")


def append_new(store: DataFrame, new: DataFrame, key: str = "link") -> DataFrame:
    """Union by key in which the store's rows win."""
    return store.unionByName(not_in(new, store, key))


def insert_new(store: DataFrame, new: DataFrame) -> DataFrame:
    """Store with the notices of new links, blank texts as null, relevant, ids going on after the greatest one.

    Of new notices that share a link the least one stays. Ids are dealt without a global sort: each bucket of links gets
    a range after a count of the buckets, and its links theirs in order. All of it depends on the rows' values alone, so
    that tasks which run again deal the same ids.
    """
    fresh = not_in(keep_first(new.withColumn("_seq", F.struct(*(c for c in STORED.names if c in new.columns))), ["link"], "_seq"), store).drop("_seq")
    return align(store).unionByName(numbered_after(fresh, store.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))))


def numbered_after(fresh: DataFrame, top: DataFrame | int) -> DataFrame:
    """Stored notices of new links, of which each is there once, with ids after the greatest one, as insert_new() deals them."""
    buckets = max(1024, 4 * int(fresh.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = [f.name for f in STORED if f.dataType.typeName() == "string"]
    fresh = fresh.withColumns({c: blank_to_null(F.col(c)) for c in text if c in fresh.columns}).withColumn("relevante", F.lit(1))
    by_link = F.row_number().over(Window.partitionBy("_bucket").orderBy("link"))
    fresh = fresh.withColumn("_bucket", F.pmod(F.xxhash64("link"), F.lit(buckets))).withColumn("_place", by_link)
    sizes = fresh.groupBy("_bucket").agg(F.count("*").alias("_size"))  # one row a bucket
    before = sizes.select("_bucket", (F.sum("_size").over(Window.orderBy("_bucket")) - F.col("_size")).alias("_before"))
    fresh = fresh.join(F.broadcast(before), "_bucket")
    fresh = fresh.withColumn("_top", F.lit(top)) if isinstance(top, int) else fresh.crossJoin(F.broadcast(top))  # one row
    return align(fresh.withColumn("id", F.col("_top") + F.col("_before") + F.col("_place")))


def folded(updates: DataFrame, key: str = "link", order: str | None = None) -> DataFrame:
    """One update for each key that isn't blank: of each column the last non-blank value, in order of a column or else of the rows' values."""
    text = {f.name for f in updates.schema if f.dataType.typeName() == "string"}
    value = {c: blank_to_null(F.col(c)) if c in text else F.col(c) for c in updates.columns if c not in (key, order)}
    known = updates.where(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) != "")
    return known.groupBy(key).agg(F.count("*").alias("_rows"), *last_given(value, order, updates.columns))


def upsert(store: DataFrame, updates: DataFrame, key: str = "link", columns: list[str] | None = None, order: str | None = None) -> DataFrame:
    """A new non-blank value wins, else the old one stays; rows of either side stay.

    Several updates for a key are applied in order of a column, or else of their own values; those without key are not.
    """
    given = [c for c in (columns or ENRICHED) if c in updates.columns and c in store.columns]
    new = folded(updates, key, order)
    new = new.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in new.columns if c not in (key, "_rows")))
    out = store.join(new, F.col(key) == F.col("_key"), "full_outer")

    def value(c: str):
        if c == key:
            return F.coalesce(F.col(key), F.col("_key"))
        if c in given:
            return F.coalesce(F.col(f"_{c}"), F.col(c))
        return F.coalesce(F.col(c), F.col(f"_{c}")) if f"_{c}" in new.columns else F.col(c)

    return out.select(*(value(c).alias(c) for c in store.columns))


def pending(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows without deadline or price, latest ids first."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    out = df.where(blank("data_limite") | blank("preco_base")).orderBy(F.desc("id"))
    return out.limit(limit) if limit else out


def backfill(store: DataFrame, details: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(store with prices and deadlines filled in, one row of counters)."""
    todo = pending(store, limit)
    found = details.join(todo.select("link"), "link", "left_semi")
    after = upsert(store, found, columns=["preco_base", "data_limite"])
    joined = todo.select("link", "preco_base", "data_limite").join(found.select("link", F.col("preco_base").alias("p"), F.col("data_limite").alias("d")), "link", "left")
    counters = joined.agg(
        F.count("*").alias("analisados"),
        F.count_if(blank_to_null(F.col("p")).isNotNull()).alias("com_preco"),
        F.count_if(blank_to_null(F.col("d")).isNotNull()).alias("com_prazo"),
        F.count_if(F.coalesce(blank_to_null(F.col("p")), blank_to_null(F.col("d"))).isNull()).alias("sem_dados"),
    )
    return after, counters


def clean_criteria(store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store with each part of the criteria's summary once, ids whose summary changed)."""
    clean = F.when(with_criteria(), dedup_bullets(F.col("criterio_resumo")))
    changed = store.where(~clean.eqNullSafe(F.col("criterio_resumo"))).select("id")
    return store.withColumn("criterio_resumo", clean), changed


def refresh_criteria(store: DataFrame, texts: DataFrame, text: str = "texto") -> DataFrame:
    """Criteria read anew out of documents (id, text); rows without a document or without criteria in it keep theirs."""
    columns = ["criterio_tipo", "criterio_resumo", "criterio_detalhe"]
    return upsert(store, already_in(enriched(texts, text).select("id", *columns), store, "id"), "id", columns)


def fill_delivery_dates(store: DataFrame, found: DataFrame) -> DataFrame:
    """Delivery dates and gazette links of a checkpoint, by link, where it has them; links that aren't stored are left out."""
    columns = ["data_entrega_propostas", "link_anuncio_dr"]
    return upsert(store, already_in(found.select("link", *columns), store), "link", columns)


def _versions(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema("version long, path string").json(f"{root.rstrip('/')}/_pointers")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "version long, path string")


def snapshot_number(spark: SparkSession, root: str) -> int:
    """The number of the latest snapshot, 0 if there is none."""
    return _versions(spark, root).agg(F.max("version")).first()[0] or 0


def write_snapshot(df: DataFrame, root: str, after: int | None = None) -> str:
    """Write a new version, then point to it; earlier versions stay as backups. Returns the version's path.

    after is the number of the snapshot that df was made from: CommitConflict is raised if another writer has taken the
    next number since. Without it the next free number is taken.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    path = f"{root}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    number = (snapshot_number(spark, root) if after is None else after) + 1
    while True:
        try:
            create_once(spark, f"{root}/_pointers/{number:012d}.json", json.dumps({"version": number, "path": path}))
            return path
        except FileExistsError:
            if after is not None:
                raise CommitConflict(f"snapshot {number} of {root} is taken") from None
            number += 1


def read_snapshot(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The latest version, or the one of a number."""
    rows = _versions(spark, root)
    last = rows.where(F.lit(number is None) | (F.col("version") == F.lit(number))).agg(F.max(F.struct("version", "path")).alias("last")).first()["last"]
    if last is None:
        raise FileNotFoundError(f"no snapshot in {root}")
    return spark.read.parquet(last["path"])
