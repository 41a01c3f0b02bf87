"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every window of 10 words the least hash of its six 5-word grams is kept, the leftmost of equals, for documents
and items alike. Equal windows keep the same gram, so every shared window is met by joining kept grams. A hit is then
extended word by word: up to five words either way, and counts if it comes to 10 words, all of them compared as text.
Items of fewer than 10 words have a window of their own length, met by the hash of all windows of that length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WINDOW = 10
GRAM = 5
#: So many bytes of the benchmark's kept grams, with the words around them, are broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 16_000_000
_REACH = WINDOW - GRAM
_PLACE = 28  # low bits that hold a gram's place in the text
#: What parts words, A-Z being lower-cased or not yet.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = BETWEEN_WORDS.replace("[", "[^", 1)


def words(text: Column) -> Column:
    """Array of words as they are written; null text has none."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN_WORDS, -1), lambda w: w != "")


def _hashed(texts: DataFrame) -> DataFrame:
    """Adds n, the number of words, and h, their hashes.

    Hashes are of fully lower-cased words, which is fast and equal wherever words with A-Z lower-cased are equal; the
    words themselves are compared once hashes have met.
    """
    counted = F.when(F.size("words") < 1 << _PLACE, F.size("words")).otherwise(F.raise_error(F.lit(f"a text of 2^{_PLACE} words or more")))
    return texts.withColumn("n", counted).withColumn("h", F.transform("words", lambda w: F.xxhash64(F.lower(w))))


def _places(count: Column) -> Column:
    """0 to count - 1, empty if count isn't positive."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _winnowed(texts: DataFrame) -> DataFrame:
    """Adds pick: hash and place of each kept gram."""
    gram = lambda i: F.shiftleft(F.xxhash64(*(F.get("h", i + j) for j in range(GRAM))), _PLACE).bitwiseOR(i.cast("long"))
    out = texts.withColumn("grams", F.transform(_places(F.col("n") - (GRAM - 1)), gram))
    least = lambda j: F.least(*(F.get("grams", j + k) for k in range(_REACH + 1)))
    picks = F.array_distinct(F.transform(_places(F.col("n") - (WINDOW - 1)), least))
    # explode() would add a filter on the array's size, and pushing that down would compute all arrays anew for each element
    return out.withColumn("picks", picks).drop("h", "grams").withColumn("pick", F.explode_outer("picks")).drop("picks")


def _around(offsets: range) -> Column:
    """The words at these offsets from a gram's place, A-Z lower-cased; null beyond either end of the text."""
    return F.array(*(F.translate(F.get("words", F.col("at") + t), UPPER, LOWER) for t in offsets))


def _parted(picked: DataFrame) -> DataFrame:
    place = F.col("pick").bitwiseAND((1 << _PLACE) - 1).cast("int")
    return picked.withColumn("gram", F.shiftright("pick", _PLACE)).withColumn("at", place).drop("pick")


def _met(scratch: Scratch, own: DataFrame, ours: DataFrame, theirs: DataFrame, offsets: range, bound: int) -> DataFrame:
    """(doc_id, version, at, ours, item_id, theirs) of equal grams, with our words at the offsets, as a stored table.

    Stored, because a later condition on arrays would else move into the join, which then leaves code generation and
    copies a text's words for each of its grams. theirs is broadcast up to bound bytes; beyond, grams are shuffled
    without the words, which are joined to what has met.
    """
    columns = ["doc_id", "version", "at", _around(offsets).alias("ours"), "item_id", "theirs"]
    size = theirs.agg(F.sum(F.octet_length(F.concat_ws(" ", "theirs")) + 40 * F.size("theirs") + 100)).first()[0] or 0
    if size <= bound:
        return scratch.keep(ours.join(F.broadcast(theirs), ["gram"]).select(*columns))
    met = scratch.keep(ours.select("doc_id", "version", "gram", "at").join(theirs, ["gram"]))
    texts = own.select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"), "words").dropDuplicates(["_d", "_v"])
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("version").eqNullSafe(F.col("_v"))
    return scratch.keep(met.join(texts, same).select(*columns))


def _short(size: int):
    """Hash of the size words from a place on: one name for each size and each run of words."""
    return lambda i: F.xxhash64(F.lit(size), *(F.get("h", i + j) for j in range(size)))


def hits(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, version, item_id, first, last): word places in a text that an item's windows cover, repeats included.

    version is a hash of the text, so that rows which share a doc_id stay apart. What has met is stored; the rest is a
    projection of that, cheaper to run again than to store.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select("doc_id", F.xxhash64("text").alias("version"), words(F.col("text")).alias("words"))
    items = _hashed(benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")))
    reach = range(-_REACH, WINDOW)
    kept = scratch.keep(_parted(_winnowed(items)).select("item_id", "gram", _around(reach).alias("theirs")).distinct())
    found = _met(scratch, own, _parted(_winnowed(_hashed(own))), kept, reach, broadcast_bytes)
    equal = F.zip_with("ours", "theirs", lambda a, b: F.coalesce(a == b, F.lit(False)))
    found = found.select("doc_id", "version", "item_id", "at", equal.alias("same"))
    found = found.where(" and ".join(f"get(same, {_REACH + j})" for j in range(GRAM)))
    run = lambda places: sum((F.when(F.expr(" and ".join(f"get(same, {p})" for p in places[: k + 1])), 1).otherwise(0) for k in range(len(places))), F.lit(0))
    before, after = run([_REACH - 1 - k for k in range(_REACH)]), run([WINDOW + k for k in range(_REACH)])
    found = found.select("doc_id", "version", "item_id", (F.col("at") - before).alias("first"), (F.col("at") + after + (GRAM - 1)).alias("last"))
    out = found.where(F.col("last") - F.col("first") >= WINDOW - 1)
    few = items.where(f"n > 0 and n < {WINDOW}").withColumn("at", F.lit(0))
    sizes = sorted(r["n"] for r in few.select("n").distinct().collect())  # nine at most
    if not sizes:
        return out
    # one pass over the texts for the windows of all these sizes
    name = F.coalesce(*(F.when(F.col("n") == k, _short(k)(F.lit(0))) for k in sizes))
    mine = scratch.keep(few.select("item_id", name.alias("gram"), _around(range(WINDOW - 1)).alias("theirs")))
    window = lambda k: F.transform(_places(F.col("n") - (k - 1)), lambda i: F.struct(_short(k)(i).alias("gram"), i.alias("at")))
    ours = _hashed(own).withColumn("w", F.explode_outer(F.concat(*map(window, sizes))))
    ours = ours.select("doc_id", "version", "words", F.col("w.gram").alias("gram"), F.col("w.at").alias("at"))
    met = _met(scratch, own, ours, mine, range(WINDOW - 1), broadcast_bytes)
    met = met.withColumn("size", F.size(F.filter("theirs", lambda w: w.isNotNull())))
    same = F.slice("ours", F.lit(1), F.col("size")) == F.slice("theirs", F.lit(1), F.col("size"))
    met = met.where(same).select("doc_id", "version", "item_id", F.col("at").alias("first"), (F.col("at") + F.col("size") - 1).alias("last"))
    return out.union(met)


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs.

    Null or empty texts have no words and no hits; rows that repeat come back as often; empty tables give no rows,
    or no hits; only doc_id and text, item_id and text are read. A text of 2^28 words or more raises an error.
    """
    found = hits(docs, benchmark, broadcast_bytes)
    key = ["doc_id", "version"]
    covered = found.select(*key, F.explode(F.sequence("first", "last")).alias("at")).distinct()
    covered = covered.groupBy(key).agg(F.count("*").alias("n_hit"))
    items = found.groupBy(key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    by_text = covered.join(items, [covered[k].eqNullSafe(items[k]) for k in key]).select(*(covered[k].alias(f"_{k}") for k in key), "n_hit", "items")
    own = docs.select("doc_id", F.xxhash64("text").alias("version"), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    out = own.join(by_text, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("version").eqNullSafe(F.col("_version")), "left")
    named = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(named).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", named), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item's window occurs; columns unchanged.

    Rows with a null or empty text stay, as do repeated rows and rows without doc_id, each by its own text. An empty
    benchmark drops nothing; an empty table gives no rows.
    """
    found = Scratch(docs.sparkSession).keep(hits(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("version").alias("_v")).distinct())
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_d"]) & F.xxhash64(docs["text"]).eqNullSafe(found["_v"]), "left_anti")


#: The same by joining all windows as text.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
r AS (SELECT doc_id, i, array_agg(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM p),
dw AS (SELECT doc_id, size, i, array_to_string(ten[1:size], ' ') AS win FROM r, (SELECT DISTINCT size FROM bw) WHERE len(ten) >= size),
h AS (SELECT doc_id, item_id, i, dw.size AS size FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
