"""Importance resampling towards a target distribution, by hashed word runs.

Higher-order functions make the array of buckets of each document, which is stored once. Only the totals of the 10,000
buckets are shuffled, summed within tasks first; the gains they give are a literal array, and a document's weight is an
aggregate over its own buckets, so that no row is exploded to be scored and nothing is joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from ..operators.numbering import numbered
from .common import Scratch
from .decontaminate import LOWER, UPPER, words
from .oracles import CRC_TABLE, crc32

BUCKETS = 10_000
LONGEST = 3  # words of the longest run
LEAST_WORDS = 20
PERCENT = 5
SEED = 42


def _runs(own: Column) -> Column:
    """Buckets of all runs of 1 to LONGEST consecutive words of an array."""
    bucket = lambda text: F.pmod(F.crc32(text), F.lit(BUCKETS)).cast("int")
    several = lambda k: F.transform(
        F.slice(own, F.lit(1), F.greatest(F.size(own) - (k - 1), F.lit(0))),
        lambda w, i: bucket(F.concat_ws(" ", w, *(F.get(own, i + j) for j in range(1, k)))),
    )
    return F.concat(F.transform(own, bucket), *(several(k) for k in range(2, LONGEST + 1)))


def featurised(texts: DataFrame) -> DataFrame:
    """doc_id, n_words, buckets of each row of texts; null and empty texts have none."""
    found = bound(words(F.translate(F.col("text").cast("string"), UPPER, LOWER)), lambda w: F.struct(F.size(w).alias("n_words"), _runs(w).alias("buckets")))
    return texts.select("doc_id", found.alias("f")).select("doc_id", "f.n_words", "f.buckets")


def _totals(features: DataFrame) -> list[int]:
    """Features in each bucket. One row a bucket comes to the driver."""
    found = features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    totals = [0] * BUCKETS
    for row in found.collect():
        totals[row["bucket"]] = row["n"]
    return totals


def gains(source: list[int], target: list[int]) -> list[int]:
    """Per bucket, a thousand times the log of how much likelier it is in the target, each count one more than seen."""
    s_all, t_all = sum(source), sum(target)
    return [math.floor(1000 * math.log(float((t + 1) * (s_all + BUCKETS)) / float((s + 1) * (t_all + BUCKETS)))) for s, t in zip(source, target)]


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise by the hash of doc_id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs; rank is null where a row isn't drawn.

    The percent of the rows with least_words words or more that have the highest scores are drawn, ties by the smaller
    doc_id. All rows count as source. Null and empty texts have no features and weight 0; a row without doc_id has no
    score and is never drawn; rows that repeat a doc_id are drawn each for itself. An empty target gives gains by the
    source alone, an empty table no rows. Only doc_id and text, and the target's text, are read.
    """
    scratch = Scratch(docs.sparkSession)
    own = scratch.keep(featurised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    wanted = featurised(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    table = ",".join(map(str, gains(_totals(own), _totals(wanted))))
    by_bucket = F.expr(f"cast(split('{table}', ',') as array<bigint>)")  # folded to one literal
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(by_bucket, b + 1))
    scored = own.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    scored = scratch.keep(scored.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)))
    scratch.drop(own)
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    # one in a hundred more than are drawn lies above the cut: its rank is off by a ten-thousandth at most
    seen = scored.where(able).agg(F.count("*").alias("n"), F.percentile_approx("score", max(0.0, (99 - percent) / 100), 10_000).alias("cut")).first()
    drawn = percent * seen["n"] // 100
    near = F.coalesce(able & (F.col("score") >= F.lit(seen["cut"]).cast("long")), F.lit(False))
    first = numbered(scored.where(near), F.desc("score"), F.asc("doc_id"), name="rank")
    first = first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = first.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def sampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of docs that are drawn, columns unchanged; of rows that repeat a doc_id all stay once one is drawn."""
    kept = resampled(docs, target, percent, least_words, seed).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long") == F.col("_drawn"), "left_semi")


def _sql_features(table: str, key: str) -> str:
    own = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = "w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
    return f"SELECT {key}, len(w) AS n_words, unnest({runs}) AS s FROM (SELECT {key}, {own} AS w FROM {table})"


#: The same by a table of features.
ORACLE_SQL = f"""
WITH {CRC_TABLE},
f AS MATERIALIZED ({_sql_features("documents", "doc_id")}), tf AS MATERIALIZED ({_sql_features("benchmark", "item_id")}),
u AS MATERIALIZED (SELECT s, {crc32("s")} % {BUCKETS} AS b FROM (SELECT s FROM f UNION SELECT s FROM tf), tab),
sc AS (SELECT b, count(*) AS n FROM f JOIN u USING (s) GROUP BY b), tc AS (SELECT b, count(*) AS n FROM tf JOIN u USING (s) GROUP BY b),
g AS (SELECT r.b, CAST(floor(1000 * ln(CAST((coalesce(tc.n, 0) + 1) * ((SELECT count(*) FROM f) + {BUCKETS}) AS DOUBLE) / CAST((coalesce(sc.n, 0) + 1) * ((SELECT count(*) FROM tf) + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS g
      FROM range({BUCKETS}) r(b) LEFT JOIN sc ON sc.b = r.b LEFT JOIN tc ON tc.b = r.b),
w AS (SELECT doc_id, any_value(n_words) AS n_words, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS weight FROM f JOIN u USING (s) JOIN g USING (b) GROUP BY doc_id),
d AS (SELECT documents.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(concat('{SEED}:', documents.doc_id)), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
      FROM documents LEFT JOIN w ON w.doc_id = documents.doc_id),
p AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM d WHERE n_words >= {LEAST_WORDS})
SELECT d.doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM d LEFT JOIN p ON p.doc_id = d.doc_id
"""
