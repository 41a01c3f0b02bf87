"""The notice table: typed, partitioned by month, clustered by link, in versions of which each rewrites only what it touches.

Files lie in <root>/data/<commit>/mes=YYYYMM/parte=N, bucketed by link. A version is a small JSON file in <root>/versions that
names the folder of each (mes, parte) it consists of. A merge writes the touched pairs anew into a folder of its own, then
commits a version that names them in place of the old ones. Version files are created only where none is there, so that of
two writers one takes the number and the other one is told. Older versions stay readable until they are vacuumed.

A version is read as an external table of the session's catalog: its partitions lie where the version says, filters on mes
and parte prune them, and joins on link need no exchange on its side.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegerType, LongType, StructField, StructType

from ..functions.dates import deadline, parse_date
from ..functions.money import parse_price
from ..functions.text import blank_to_null
from ..schema import ENRICHED, STORED, align
from ..stored import CommitConflict, Scratch, create_once, hadoop
from .store import folded, numbered_after

UNDATED = 0
#: Columns that are parsed once, when a row is stored.
TYPED = [StructField("data_publicacao", DateType()), StructField("data_fim", DateType()), StructField("preco", DecimalType(28, 6))]
SCHEMA = StructType([*STORED.fields, *TYPED, StructField("mes", IntegerType()), StructField("parte", IntegerType())])
_PLACE = ["mes", "parte"]


@dataclass(frozen=True)
class Version:
    """One version of a table: its number, the folder of each (mes, parte), what was merged into it, the greatest id."""

    root: str
    number: int = 0
    buckets: int = 8
    parts: int = 4
    folders: tuple[tuple[int, int, str], ...] = ()
    batches: tuple[tuple[str, int], ...] = ()  # last batch of each stream
    top: int = 0

    def months(self) -> list[int]:
        return sorted({m for m, _, _ in self.folders})


def month_key(day: Column) -> Column:
    """YYYYMM of a date, UNDATED for null; folded to a literal where day is one, so that it prunes partitions."""
    return F.coalesce(F.year(day) * 100 + F.month(day), F.lit(UNDATED))


def part_of(link: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(link), F.lit(parts)).cast("int")


def typed_rows(df: DataFrame, parts: int, *more: str) -> DataFrame:
    """Stored notices with what filters read: dates, price, month and part; and more columns of df."""
    out = align(df, StructType([*STORED.fields, *(df.schema[c] for c in more)])).withColumn("data_publicacao", parse_date(F.col("data"))).withColumn("preco", parse_price(F.col("preco_base")))
    out = out.withColumn("data_fim", deadline(F.col("data_publicacao"), F.col("data_limite")))
    return out.withColumn("mes", month_key(F.col("data_publicacao"))).withColumn("parte", part_of(F.col("link"), parts)).select(*SCHEMA.names, *more)


# Versions ---------------------------------------------------------------------------------------------------------------


def _file(root: str, number: int) -> str:
    return f"{root}/versions/{number:012d}.json"


def latest(spark: SparkSession, root: str) -> Version:
    """The version of the greatest number."""
    root = root.rstrip("/")
    place, files = hadoop(spark, f"{root}/versions")
    if not files.exists(place):
        raise FileNotFoundError(f"no table in {root}")
    return at(spark, root, max(int(f.getPath().getName()[:-5]) for f in files.listStatus(place) if f.getPath().getName().endswith(".json")))


def at(spark: SparkSession, root: str, number: int) -> Version:
    """A version by its number."""
    text = spark.read.text(_file(root.rstrip("/"), number), wholetext=True).first()[0]
    said = json.loads(text)
    return Version(root.rstrip("/"), number, said["buckets"], said["parts"], tuple(map(tuple, said["folders"])), tuple(map(tuple, said["batches"])), said["top"])


def commit(spark: SparkSession, version: Version) -> Version:
    """Take a version's number, or raise CommitConflict if it is taken."""
    body = {k: getattr(version, k) for k in ("buckets", "parts", "folders", "batches", "top")}
    try:
        create_once(spark, _file(version.root, version.number), json.dumps(body))
    except FileExistsError:
        raise CommitConflict(f"version {version.number} of {version.root} is taken") from None
    return version


# Reading ----------------------------------------------------------------------------------------------------------------


def read(spark: SparkSession, version: Version) -> DataFrame:
    """A version's rows, as a table of the session whose partitions lie where the version says."""
    name = f"notices_{hashlib.md5(repr(version).encode()).hexdigest()}"
    if spark.catalog.tableExists(name):
        return spark.table(name)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMA)
    home, files = hadoop(spark, f"{version.root}/data")
    files.mkdirs(home)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (mes, parte) CLUSTERED BY (link) SORTED BY (link) INTO {version.buckets} BUCKETS LOCATION '{home}'"
    )
    folders = [f"PARTITION (mes={m}, parte={p}) LOCATION '{version.root}/data/{c}/mes={m}/parte={p}'" for m, p, c in version.folders]
    for i in range(0, len(folders), 1000):
        spark.sql(f"ALTER TABLE {name} ADD {' '.join(folders[i : i + 1000])}")
    return spark.table(name)


def published(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows published in [start, end); months outside aren't read."""
    months = (F.col("mes") >= month_key(start)) & (F.col("mes") <= month_key(F.date_sub(end, 1)))
    return rows.where(months & (F.col("data_publicacao") >= start) & (F.col("data_publicacao") < end))


def since(rows: DataFrame, day: Column, undated: bool = True) -> DataFrame:
    """Rows published on a day or later, undated ones too unless said otherwise; months before aren't read."""
    months, days = F.col("mes") >= month_key(day), F.col("data_publicacao") >= day
    if undated:
        months, days = months | (F.col("mes") == UNDATED), days | F.col("data_publicacao").isNull()
    return rows.where(months & days)


def by_link(rows: DataFrame, version: Version, link: str) -> DataFrame:
    """The row of a link: one part of each month, and there one bucket."""
    return rows.where((F.col("parte") == part_of(F.lit(link), version.parts)) & (F.col("link") == link))


# Writing ----------------------------------------------------------------------------------------------------------------


def _write(rows: DataFrame, version: Version) -> tuple[tuple[int, int, str], ...]:
    """Rows into a folder of their own; what is there, by (mes, parte)."""
    spark, commit_name = rows.sparkSession, uuid.uuid4().hex
    name, path = f"write_{commit_name}", f"{version.root}/data/{commit_name}"
    # dealt by folder and bucket, so that each of its files is written by one task, and as many tasks as there are write
    dealt = rows.repartition(*_PLACE, F.pmod(F.hash("link"), F.lit(version.buckets)))
    dealt.write.format("parquet").partitionBy(*_PLACE).bucketBy(version.buckets, "link").sortBy("link").option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # external: its files stay
    found = []
    place, files = hadoop(spark, path)
    for month in files.listStatus(place):
        if month.getPath().getName().startswith("mes="):
            for part in files.listStatus(month.getPath()):
                found.append((int(month.getPath().getName()[4:]), int(part.getPath().getName()[6:]), commit_name))
    return tuple(found)


def create(spark: SparkSession, root: str, df: DataFrame, buckets: int = 8, parts: int = 4) -> Version:
    """The first version, of stored notices; rows without link can't be updated but stay."""
    empty = Version(root.rstrip("/"), 1, buckets, parts)
    rows = typed_rows(df, parts)
    top = df.agg(F.max("id")).first()[0] or 0
    return commit(spark, replace(empty, folders=tuple(sorted(_write(rows, empty))), top=top))


def merge(spark: SparkSession, version: Version, updates: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None, insert: bool = True) -> Version:
    """The next version: updates laid over the rows of their links, new links inserted.

    Only the (mes, parte) in which a row becomes different or arrives are written; a row whose date changes leaves its old
    month. A batch (stream, number) that the version already holds changes nothing, so that a batch may be given twice.
    Where nothing becomes different the version stays, or is committed with its folders as they are if a batch is to be
    noted. Raises CommitConflict if another writer was faster.
    """
    done = dict(version.batches)
    if batch and done.get(batch[0], -1) >= batch[1]:
        return version
    scratch = Scratch(spark)
    new = _one_each(scratch, updates, order)
    store = read(spark, version)
    # where the links are: their month and part only, from the store as it lies; updates go to its buckets
    here = scratch.keep(store.select("link", *_PLACE).join(new.select("link"), "link", "left_semi"))
    laid = _laid_over(_at_places(store, here), new)
    # all rows of a link of which one differs; the join has brought them together
    laid = laid.withColumn("_differs", F.max("_differs").over(Window.partitionBy("link"))).where("_differs")
    # a bucket is a task so far; parsing is for as many as there are
    laid = laid.repartition("link", "id")
    moving = scratch.keep(typed_rows(laid, version.parts, "_mes", "_parte"))
    changed = moving.drop("_mes", "_parte")
    fresh = new.join(here.select("link"), "link", "left_anti")
    arrived = scratch.keep(typed_rows(numbered_after(fresh, version.top), version.parts)) if insert else changed.limit(0)
    places = moving.select("_mes", "_parte").union(moving.select(*_PLACE)).union(arrived.select(*_PLACE)).toDF(*_PLACE)
    moved = places.distinct().collect()  # a row a folder
    touched = {(r["mes"], r["parte"]) for r in moved}
    if not touched and not batch:
        scratch.clear()
        return version
    stay = _in_places(store, touched).join(changed.select("link"), "link", "left_anti")
    written = _write(stay.unionByName(changed).unionByName(arrived), version) if touched else ()
    folders = tuple(f for f in version.folders if f[:2] not in touched) + written
    top = max(version.top, arrived.agg(F.max("id")).first()[0] or 0)
    if batch:
        done[batch[0]] = batch[1]
    out = replace(version, number=version.number + 1, folders=tuple(sorted(folders)), batches=tuple(sorted(done.items())), top=top)
    scratch.clear()
    return commit(spark, out)


def _one_each(scratch: Scratch, updates: DataFrame, order: str | None) -> DataFrame:
    """folded() of updates, stored. A link's only update goes through the aggregate once, not with each of its columns."""
    names = [c for c in updates.columns if c not in ("link", order)]
    if not names:
        return scratch.keep(folded(updates, "link", order).drop("_rows"))
    known = updates.where(F.coalesce(F.trim("link"), F.lit("")) != "")
    first = scratch.keep(known.groupBy("link").agg(F.count("*").alias("_rows"), F.max(F.struct(*names)).alias("_row")))
    text = {f.name for f in updates.schema if f.dataType.typeName() == "string"}
    value = lambda c: F.col(f"_row.`{c}`")
    once = first.where("_rows = 1").select("link", *((blank_to_null(value(c)) if c in text else value(c)).alias(c) for c in names))
    more = first.where("_rows > 1").select("link")
    if more.isEmpty():
        return once
    return scratch.keep(once.unionByName(folded(updates.join(more, "link", "left_semi"), "link", order).drop("_rows")))


def _laid_over(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows of the links of new, one update a link, with its values, where they were, and whether they differ now."""
    given = [c for c in ENRICHED if c in new.columns]
    both = rows.join(new.select(F.col("link").alias("_link"), *(F.col(c).alias(f"_new_{c}") for c in given)), F.col("link") == F.col("_link"))
    differs = F.lit(False)
    for c in given:
        differs = differs | (F.col(f"_new_{c}").isNotNull() & ~F.col(f"_new_{c}").eqNullSafe(F.col(c)))
    values = (F.coalesce(f"_new_{c}", c).alias(c) if c in given else F.col(c) for c in STORED.names)
    return both.select(*values, differs.alias("_differs"), F.col("mes").alias("_mes"), F.col("parte").alias("_parte"))


def _in_places(store: DataFrame, places: set[tuple[int, int]]) -> DataFrame:
    """Rows of these (mes, parte), by a filter that prunes the others."""
    by_month: dict[int, list[int]] = {}
    for m, p in places:
        by_month.setdefault(m, []).append(p)
    by_parts: dict[tuple[int, ...], list[int]] = {}
    for m, p in by_month.items():
        by_parts.setdefault(tuple(sorted(p)), []).append(m)
    keep = F.lit(False)
    for parts, months in by_parts.items():
        keep = keep | (F.col("mes").isin(sorted(months)) & F.col("parte").isin(list(parts)))
    return store.where(keep)


def _at_places(store: DataFrame, rows: DataFrame) -> DataFrame:
    return _in_places(store, {(r["mes"], r["parte"]) for r in rows.select(*_PLACE).distinct().collect()})


# Versions against each other --------------------------------------------------------------------------------------------


def difference(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key, change) of rows that were inserted, updated or deleted between two versions; nulls are values like others."""
    shared = [c for c in before.columns if c in after.columns and c not in (key, *_PLACE)]
    row = F.struct(*shared)
    a, b = before.select(F.col(key).alias("_a"), row.alias("old")), after.select(F.col(key).alias("_b"), row.alias("new"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    change = F.when(F.col("_a").isNull(), "inserted").when(F.col("_b").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "updated")
    return both.select(F.coalesce("_a", "_b").alias(key), change.alias("change")).where("change is not null")


def changes(spark: SparkSession, before: Version, after: Version, key: str = "id") -> DataFrame:
    """The difference of two versions of one table, from the folders that they don't share alone."""
    only = lambda x, y: replace(x, folders=tuple(f for f in x.folders if f not in set(y.folders)))
    return difference(read(spark, only(before, after)), read(spark, only(after, before)), key)


def change_counts(changed: DataFrame) -> DataFrame:
    """One row: inserted, updated, deleted."""
    return changed.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("inserted", "updated", "deleted")))


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete versions but the last ones, and the folders that none of those names."""
    root = root.rstrip("/")
    last = latest(spark, root).number
    kept = [at(spark, root, n) for n in range(max(1, last - keep + 1), last + 1)]
    named = {c for v in kept for _, _, c in v.folders}
    place, files = hadoop(spark, f"{root}/data")
    for f in files.listStatus(place):
        if f.getPath().getName() not in named:
            files.delete(f.getPath(), True)
    for n in range(1, last - keep + 1):
        files.delete(hadoop(spark, _file(root, n))[0], False)


def merge_retrying(spark: SparkSession, root: str, updates: DataFrame, attempts: int = 5, **options) -> Version:
    """Merge into the latest version, anew where another writer was faster."""
    for left in range(attempts - 1, -1, -1):
        try:
            return merge(spark, latest(spark, root), updates, **options)
        except CommitConflict:
            if not left:
                raise
    raise ValueError("attempts must be positive")


__all__ = ["CommitConflict", "Version", "at", "by_link", "change_counts", "changes", "commit", "create", "difference", "latest", "merge", "merge_retrying", "published", "read", "since", "typed_rows", "vacuum"]
