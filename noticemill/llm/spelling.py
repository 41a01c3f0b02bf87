"""Spelling variants: words one edit apart, met by bands of a letter-parity mask.

A word's mask has a bit for each letter, set if the letter stands in it an odd number of times. One inserted or deleted
letter flips one bit, a replaced one two, so that of three bands of bits one at least is equal. Words meet in a band's
value and their length, the shorter one of two also in the length after its own; masks, then the words themselves, are
compared. A cell of more than dense_cell words is left to the words without one letter each: who are one edit apart share
such a string, and no such string belongs to more words than there are letters and places. Nothing is dropped by that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .decontaminate import LOWER, UPPER
from .oracles import CRC_TABLE, crc32

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
ONE_IN = 199
DENSE_CELL = 1024
_BANDS = 3
BETWEEN_RUNS = r"[^A-Za-zÀ-ÿ]+"


def counted_words(docs: DataFrame, one_in: int = ONE_IN, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; one occurrence in one_in, by hash, has lost a letter."""
    runs = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), BETWEEN_RUNS, -1), lambda r: F.length(r) >= least_length)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode_outer(runs).alias("run")).where("run is not null")
    rows = rows.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))
    rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "doc_id", "run")))
    at = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = rows.select(F.when(F.pmod("h", F.lit(one_in)) == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _masks(word: Column) -> Column:
    """Three numbers of 30 bits; letters are dealt to them in turn."""
    code = lambda c: F.ascii(c)
    index = lambda c: F.when(code(c) >= 0xC0, code(c) - 0xC0 + 26).otherwise(code(c) - ord("a"))
    bit = lambda c: F.call_function("shiftleft", F.lit(1), F.floor(index(c) / _BANDS).cast("int"))
    band = lambda b: F.aggregate(F.filter(F.split(word, ""), lambda c: F.pmod(index(c), F.lit(_BANDS)) == b), F.lit(0), lambda m, c: m.bitwiseXOR(bit(c)))
    return F.array(*map(band, range(_BANDS)))


def _one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame, dense_cell: int = DENSE_CELL) -> DataFrame:
    """(u, nu, v, nv): each pair of words (word, n) one edit apart, once."""
    scratch = Scratch(words.sparkSession)
    masked = scratch.keep(words.select("word", "n", F.length("word").alias("size"), _masks(F.col("word")).alias("m")))
    homes = [F.struct(F.lit(b).alias("band"), F.get("m", F.lit(b)).alias("value"), (F.col("size") + more).alias("length")) for b in range(_BANDS) for more in (0, 1)]
    cells = masked.select("word", "n", "size", "m", F.explode(F.array(*homes)).alias("cell")).select("*", "cell.*").drop("cell")
    key = ["band", "value", "length"]
    sizes = scratch.keep(cells.groupBy(key).agg(F.count("*").alias("members"), F.count_if(F.col("size") == F.col("length")).alias("own")).where("members > 1 and own > 0").drop("own"))
    sparse = cells.join(sizes.where(F.col("members") <= dense_cell).select(key), key)
    a = sparse.where("size = length").select(*key, F.col("word").alias("u"), F.col("n").alias("nu"), F.col("m").alias("mu"))
    b = sparse.select(*key, F.col("word").alias("v"), F.col("n").alias("nv"), F.col("m").alias("mv"), F.col("size").alias("sv"))
    differ = lambda i: F.get("mu", F.lit(i)) != F.get("mv", F.lit(i))
    flipped = sum((F.bit_count(F.get("mu", F.lit(i)).bitwiseXOR(F.get("mv", F.lit(i)))) for i in range(_BANDS)), F.lit(0))
    first = (F.col("band") == 0) | (differ(0) & ((F.col("band") == 1) | differ(1)))  # a pair counts in its first equal band
    met = a.join(b, key).where((F.col("sv") < F.col("length")) | (F.col("u") < F.col("v"))).where(first & (flipped <= 2) & _one_edit(F.col("u"), F.col("v")))
    hot = cells.join(sizes.where(F.col("members") > dense_cell).select(key), key, "left_semi").select("word", "n").distinct()
    return met.select("u", "nu", "v", "nv").union(_by_deletion(hot)).select(*_ordered()).distinct()


def _ordered() -> list[Column]:
    swap = F.col("u") > F.col("v")
    pick = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    return [pick("u", "v", "u"), pick("nu", "nv", "nu"), pick("v", "u", "v"), pick("nv", "nu", "nv")]


def _by_deletion(words: DataFrame) -> DataFrame:
    """The same pairs by the strings that are left without one letter."""
    without = lambda i: F.concat(F.substr("word", F.lit(1), i), F.substr("word", i + 2))
    left = F.array_distinct(F.transform(F.sequence(F.lit(0), F.length("word") - 1), without))
    parts = words.select("word", "n", F.explode(left).alias("rest"))
    a = parts.select("rest", F.col("word").alias("u"), F.col("n").alias("nu"))
    b = parts.select("rest", F.col("word").alias("v"), F.col("n").alias("nv"))
    replaced = a.join(b, "rest").where((F.col("u") < F.col("v")) & _one_edit(F.col("u"), F.col("v")))
    whole = words.select(F.col("word").alias("rest"), F.col("word").alias("v"), F.col("n").alias("nv"))
    return replaced.select("u", "nu", "v", "nv").union(a.join(whole, "rest").select("u", "nu", "v", "nv"))


def _roots(forms: DataFrame, rounds: int, scratch: Scratch) -> DataFrame:
    """(word, root) of the words that have a form; each round doubles the steps that are taken."""
    found = scratch.keep(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        after = found.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        before, found = found, scratch.keep(found.join(after, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
        scratch.drop(before)
    return found


def spelling_variants(docs: DataFrame, ratio: int = RATIO, dense_cell: int = DENSE_CELL) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of docs that is long and frequent enough.

    form is the most frequent near word, of equals the first in code-point order, if it is ratio times as frequent as the
    word; root is where forms lead to. Null and empty texts have no words, a null doc_id counts as an empty text in the
    hash, rows that repeat count each; an empty table gives no rows. Only doc_id and text are read.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.keep(counted_words(docs))
    pairs = scratch.keep(near_pairs(words, dense_cell))
    both = pairs.select(F.col("u").alias("word"), F.col("v").alias("other"), F.col("nv").alias("m")).union(pairs.select("v", "u", "nu"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    out = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.m") >= F.lit(ratio) * F.col("n"), -F.col("best.m")))
    out = scratch.keep(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.other")).alias("form"), "form_n"))
    # n grows at least ratio-fold with each step, so the greatest n bounds the steps
    greatest, steps, rounds = words.agg(F.max("n")).first()[0] or 0, 0, 0
    while greatest >= ratio:
        greatest, steps = greatest // ratio, steps + 1
    while 1 << rounds < steps:
        rounds += 1
    roots = _roots(out.where("form is not null"), rounds, scratch)
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def normalised_words(variants: DataFrame) -> DataFrame:
    """(word, root) of the words that a text would be rewritten with."""
    return variants.where("form is not null").select("word", "root")


#: The same by the strings that are left without the letter of each place.
ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM r WHERE len(run) >= {LEAST_LENGTH} GROUP BY ALL),
h AS (SELECT run, n, {crc32("concat(doc_id, ':', run)")} AS h FROM g, tab),
o AS (SELECT CASE WHEN h % {ONE_IN} = 0 THEN concat(left(run, h % len(run)), substr(run, h % len(run) + 2)) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE len(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
k AS MATERIALIZED (SELECT word, n, i, concat(left(word, i), substr(word, i + 2)) AS rest FROM (SELECT word, n, unnest(range(len(word))) AS i FROM v)),
p AS (SELECT a.word AS u, b.word AS w, b.n AS m FROM k a JOIN k b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT k.word, v.word, v.n FROM k JOIN v ON k.rest = v.word UNION SELECT v.word, k.word, k.n FROM k JOIN v ON k.rest = v.word),
b AS (SELECT u, w, m, row_number() OVER (PARTITION BY u ORDER BY m DESC, w) AS place, count(*) OVER (PARTITION BY u) AS n_near FROM p),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * v.n THEN w END AS form, CASE WHEN m >= {RATIO} * v.n THEN m END AS form_n
      FROM v LEFT JOIN b ON b.u = v.word AND place = 1),
t AS (SELECT word, word AS root FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word JOIN f AS e ON e.word = t.root AND e.form IS NULL
"""
