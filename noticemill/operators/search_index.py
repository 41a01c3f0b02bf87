"""Substring index: postings of the one to three character grams of the searched columns' texts.

Each distinct text is indexed once, under its hash; holders say which rows have it. A term's rarest grams are looked up, the
rows of the texts that have all of them are candidates, and candidates are checked against their rows, so that hits are
those of a scan and texts that share a hash do no harm. Postings lie in folders by the hash of the gram, sorted by gram, so
that a lookup opens a few folders and skips what lies outside the gram's stretch of them; holders lie likewise by text.
Terms shorter than three characters are grams themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bound
from .filters import contains_text

LONGEST = 3
USED = 3  # grams of a term that are looked up
TEXTS = 100_000  # texts whose postings a task sorts
BROADCAST = 100_000  # texts of a term up to which all tasks get them; more are joined by key
POSTINGS, COUNTS, HOLDERS = "key long, gram string, part int", "gram string, n long, part int", "id long, key long, part int"


@dataclass(frozen=True)
class Index:
    root: str
    columns: tuple[str, ...]
    parts: int


def grams_of(term: str) -> list[str]:
    """Distinct grams of a term: of three characters, or the term itself if it is shorter; none of an empty one."""
    if not term:
        return []
    size = min(LONGEST, len(term))
    return sorted({term[i : i + size] for i in range(len(term) - size + 1)})


def _grams(text: Column) -> Column:
    """Distinct grams of one to three characters of a lower-cased text."""

    def of(chars: Column) -> Column:
        run = lambda k: F.transform(F.slice(chars, F.lit(1), F.greatest(F.size(chars) - (k - 1), F.lit(0))), lambda c, i: F.concat(c, *(F.get(chars, i + j) for j in range(1, k))))
        return F.array_distinct(F.concat(*(run(k) for k in range(1, LONGEST + 1))))

    return bound(F.filter(F.split(text, ""), lambda c: c != ""), of)


def _part(gram: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(parts)).cast("int")


def build(rows: DataFrame, root: str, columns: tuple[str, ...] = ("titulo", "entidade", "cpv"), parts: int = 16, salt: int = 4) -> Index:
    """Store the index of rows, which have an id. Texts are dealt to parts * salt tasks, to more where there are many.

    Each task sorts and writes what it has read: neither postings nor holders are exchanged, of texts only distinct ones.
    """
    root, spark = root.rstrip("/"), rows.sparkSession
    each = F.explode(F.array_distinct(F.array(*(F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns)))).alias("text")
    held = rows.select(F.col("id").cast("long").alias("id"), each).where("text <> ''").select("id", F.xxhash64("text").alias("key"))
    _store(held.withColumn("part", _part(F.col("key"), parts)), f"{root}/holders", "key", "id")
    rows.select(each).where("text <> ''").distinct().write.parquet(f"{root}/texts")
    texts = spark.read.schema("text string").parquet(f"{root}/texts")
    dealt = texts.repartition(max(parts * salt, texts.count() // TEXTS), "text")
    postings = dealt.select(F.xxhash64("text").alias("key"), F.explode(_grams(F.col("text"))).alias("gram"))
    _store(postings.withColumn("part", _part(F.col("gram"), parts)), f"{root}/postings", "gram", "key")
    counts = spark.read.schema(POSTINGS).parquet(f"{root}/postings").groupBy("part", "gram").agg(F.count("*").alias("n"))
    counts.repartition(parts, "part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{root}/counts")
    return Index(root, tuple(columns), parts)


def _store(df: DataFrame, path: str, *order: str) -> None:
    df.sortWithinPartitions("part", *order).write.option("compression", "zstd").partitionBy("part").parquet(path)


def _of_grams(df: DataFrame, index: Index, grams: list[str]) -> DataFrame:
    """Rows of these grams; other folders are pruned, as the hashes of literals fold to literals."""
    return df.where(F.col("part").isin(*(_part(F.lit(g), index.parts) for g in grams))).where(F.col("gram").isin(grams))


def candidates(spark: SparkSession, index: Index, term: str) -> DataFrame | None:
    """Ids of the rows with a text that holds a term's rarest grams, once for each such text; None if the term has no grams, as all rows are hits then."""
    grams = grams_of(term.strip().lower())
    if not grams:
        return None
    counts = {r["gram"]: r["n"] for r in _of_grams(spark.read.schema(COUNTS).parquet(f"{index.root}/counts"), index, grams).collect()}  # a row a gram of the term
    postings = spark.read.schema(POSTINGS).parquet(f"{index.root}/postings")
    holders = spark.read.schema(HOLDERS).parquet(f"{index.root}/holders")
    if len(counts) < len(grams):
        return holders.limit(0).select("id")
    rarest = sorted(grams, key=lambda g: (counts[g], g))[:USED]
    bit = F.element_at(F.create_map(*(F.lit(x) for i, g in enumerate(rarest) for x in (g, 1 << i))), F.col("gram"))
    keys = _of_grams(postings, index, rarest).groupBy("key").agg(F.bit_or(bit).alias("has")).where(F.col("has") == (1 << len(rarest)) - 1)
    keys = keys.select("key", _part(F.col("key"), index.parts).alias("part"))
    if counts[rarest[0]] <= BROADCAST:
        keys = F.broadcast(keys)
    return keys.join(holders, ["part", "key"]).select("id")


def search(rows: DataFrame, index: Index, term: str) -> DataFrame:
    """Rows in which a column holds the term, case not counting: the same as a scan with contains_text()."""
    found = candidates(rows.sparkSession, index, term)
    if found is None:
        return rows
    return rows.join(found, "id", "left_semi").where(contains_text(term, *index.columns))
