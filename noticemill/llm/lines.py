"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling, later copies of maximal runs deleted.

Doubling: a suffix begins at a line and is named by the rank of its first 1, 2, 4, ... lines among all such prefixes that
occur more than once. A round joins each rank with the rank as many lines further on, sorts the distinct pairs that occur
more than once by range and numbers them; suffixes without such a pair leave. It ends when no suffix is left.

Intervals: suffixes with a common prefix are an interval of the suffix array, a node. Those that share no longer power
of two stay in the node of their last rank, with the first suffix of each longer class for all of that class. Going
down the powers, the members of a node that also share the next lines become a node of their own, and the first of
them stays behind for them. The depth of the last node in which a suffix isn't the first is the longest prefix that it
has in common with any suffix before it: its maximal run. Classes whose members all follow the same line are left
out, since the runs from that line on hold theirs.

Every step is a join or an aggregate by key: no class, text or array is held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, line_hash

#: A repeated run counts with so many lines and characters in all, blank ones without characters, or as one long line.
MIN_LINES = 2
MIN_CHARS = 30
ALONE_CHARS = 80
_KEY = ["doc_id", "version", "n"]


def _lines(text: Column | str) -> Column:
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)


def _place() -> Column:
    return F.struct(*_KEY)


def _ranked(scratch: Scratch, suffixes: DataFrame, names: list[str]) -> DataFrame | None:
    """(key, left, rank, first, diverse) of the suffixes whose names several places share, stored; null if there is none.

    The suffixes are a stored table, as they are read twice; it is dropped.
    first: whether it is the first of its class. diverse: whether its class doesn't always follow the same line.
    """
    shared = suffixes.groupBy(*names).agg(
        F.min(_place()).alias("least"),
        F.max(_place()).alias("most"),
        (F.coalesce(F.min("left") < F.max("left"), F.lit(True)) | (F.count("left") < F.count("*"))).alias("diverse"),
    )
    ranked = shared.where("least < most").orderBy(*names).select(*names, F.monotonically_increasing_id().alias("rank"), "least", "diverse")
    shared, out = scratch.keep(ranked), None
    if not shared.isEmpty():
        out = scratch.keep(suffixes.join(shared, names).select(*_KEY, "left", shared["rank"].alias("rank"), (_place() == F.col("least")).alias("first"), "diverse"))
    scratch.drop(shared, suffixes)
    return out


def suffix_ranks(docs: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The suffixes that share their first 2^k lines with another one, for each k, ranked by these lines."""
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.posexplode(_lines("text")).alias("n", "line"))
    a, b = line_hash(F.col("line"))
    single = scratch.keep(own.select(*_KEY, a.alias("a"), b.alias("b")))
    shared = single.groupBy("a", "b").agg(F.min(_place()).alias("least"), F.max(_place()).alias("most")).where("least < most")
    shared = scratch.keep(shared.orderBy("a", "b").select("a", "b", F.monotonically_increasing_id().alias("rank")))
    named = scratch.keep(single.join(shared, ["a", "b"]).select(*_KEY, "rank").distinct())  # rows may repeat
    scratch.drop(single, shared)
    before = named.select("doc_id", "version", (F.col("n") + 1).alias("n"), F.col("rank").alias("left"))
    followed = scratch.keep(named.join(before, _KEY, "left").withColumnRenamed("rank", "a"))
    scratch.drop(named)
    levels: list[DataFrame] = []
    level = _ranked(scratch, followed, ["a"])
    while level is not None:
        last = level.select(*_KEY, "left", F.col("rank").alias("a"))
        further = last.select("doc_id", "version", (F.col("n") - (1 << len(levels))).alias("n"), F.col("a").alias("b"))
        levels.append(level)
        level = _ranked(scratch, scratch.keep(last.join(further, _KEY)), ["a", "b"])
    return levels


def _entering(levels: list[DataFrame], k: int) -> DataFrame:
    """Members of the nodes of depth 2^k: suffixes that share no more lines by rank, and the first of each class that does."""
    rows = levels[k].where("diverse")
    if k + 1 < len(levels):
        rows = rows.join(levels[k + 1].select(*_KEY, F.col("first").alias("more")), _KEY, "left").where("more is null or more")
    return rows.select(F.lit(2 * k + 1).alias("kind"), F.col("rank").alias("node"), *_KEY, F.lit(1 << k).alias("depth"), "first")


def maximal_runs(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, version, n, length): runs of lines from line n on that also begin at an earlier place.

    Of each place the longest such run is there, unless it lies within the run of the line before. Places are ordered by
    (doc_id, hash of the text, line).
    """
    levels = suffix_ranks(docs, scratch)
    stored: list[DataFrame] = []
    for k in reversed(range(len(levels))):
        members, read = _entering(levels, k), levels[k + 1 : k + 2]
        if stored:
            # members of the deeper nodes; a node with one member is done
            alone = stored[-1].groupBy("kind", "node").agg(F.count("*").alias("size")).where("size > 1").select("kind", "node")
            held = stored[-1].join(alone, ["kind", "node"], "left_semi").withColumn("at", F.col("n") + F.col("depth"))
            # those that share the 2^k lines that follow with another one move on, and the first of them stays, too
            following = levels[k].select("doc_id", "version", F.col("n").alias("at"), F.col("rank").alias("next"))
            held = scratch.keep(held.join(following, ["doc_id", "version", "at"], "left"))  # read twice
            longer = held.where("next is not null").groupBy("kind", "node", "next").agg(F.min(_place()).alias("least"), F.max(_place()).alias("most"))
            longer = scratch.keep(longer.where("least < most").select("kind", "node", "next", "least", F.monotonically_increasing_id().alias("name")))
            tried = held.join(longer, ["kind", "node", "next"], "left")
            leads = _place() == F.col("least")
            stays = F.struct("kind", "node", "depth", "first")
            moves = F.struct(F.lit(2 * k).alias("kind"), F.col("name").alias("node"), (F.col("depth") + (1 << k)).alias("depth"), leads.alias("first"))
            then = F.when(F.col("name").isNull(), F.array(stays)).when(leads, F.array(stays, moves)).otherwise(F.array(moves))
            members = members.unionByName(tried.select(*_KEY, F.inline(then)))
            read += [held, longer]
        stored.append(scratch.keep(members))
        scratch.drop(*read)
    if not stored:
        return docs.sparkSession.createDataFrame([], "doc_id long, version long, n int, length int")
    out = stored[0]
    for more in stored[1:]:
        out = out.union(more)
    return out.where("not first").groupBy(*_KEY).agg(F.max("depth").alias("length"))


def covered(chars: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each line lies in a run that counts, chars being the characters of each line."""
    total = np.append(0, np.cumsum(chars))
    whole = total[first + length] - total[first]
    counts = (length >= MIN_LINES) & (whole >= MIN_CHARS) | (whole >= ALONE_CHARS)
    depth = np.bincount(first[counts], minlength=len(chars) + 1) - np.bincount((first + length)[counts], minlength=len(chars) + 1)
    return np.cumsum(depth)[:-1] > 0


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, n_lines, n_removed, n_runs, left) of (row, text, firsts, lengths); left is null if nothing is removed."""
    for batch in batches:
        rows = []
        for text, firsts, lengths in zip(batch.column(1), batch.column(2), batch.column(3)):
            parts = (text.as_py() or "").split("\n")
            if firsts.as_py() is None:
                rows.append((len(parts), 0, 0, None))
                continue
            gone = covered(np.fromiter(map(len, parts), np.int64, len(parts)), firsts.values.to_numpy(), lengths.values.to_numpy())
            starts = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            left = "\n".join(p for p, x in zip(parts, gone.tolist()) if not x) if starts else None
            rows.append((len(parts), int(gone.sum()), starts, left))
        columns = list(zip(*rows)) if rows else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["row", "n_lines", "n_removed", "n_runs", "left"])


def _stripped(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(row, n_lines, n_removed, n_runs, left), row being a struct of the named columns as c0, c1, ..."""
    scratch = Scratch(docs.sparkSession)
    runs = maximal_runs(docs, scratch).groupBy(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"))
    runs = scratch.keep(runs.agg(F.collect_list("n").alias("_firsts"), F.collect_list("length").alias("_lengths")))
    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    own = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), row.alias("row"), F.col("text").cast("string").alias("text"))
    own = own.join(runs, (F.col("_id") == F.col("_doc")) & (F.col("_hash") == F.col("_version")), "left").select("row", "text", "_firsts", "_lengths")
    kind = own.schema["row"].dataType.simpleString()
    return own.mapInArrow(_strip, f"row {kind}, n_lines long, n_removed long, n_runs long, left string")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs (maximal runs removed), kept_sha256 of each row of docs.

    Of equal runs the one with the least (doc_id, hash of the text, line) stays, wherever the others are, in the same
    text too. A null text counts as one empty line. Exact repeats of a row are one text and keep the same lines. Rows
    without doc_id keep all lines. An empty table gives no rows; other columns are not read.
    """
    out = _stripped(docs, ["doc_id", "text"])
    left = F.coalesce("left", F.col("row.c1").cast("string"), F.lit(""))
    return out.select(F.col("row.c0").cast("long").alias("doc_id"), "n_lines", "n_removed", "n_runs", F.sha2(left, 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with later copies of line runs deleted from text, as in dedup_lines, and n_chars set anew.

    Rows that lose all they had go; those that lose nothing stay as they are, also with null or empty texts and without
    doc_id. Repeated rows stay as often. An empty table gives no rows.
    """
    out = _stripped(docs, docs.columns).where("left is null or trim(left) <> ''")
    columns = {c: F.col(f"row.c{i}") for i, c in enumerate(docs.columns)}
    whole = F.col("left").isNull()
    columns["text"] = F.when(whole, columns["text"]).otherwise(F.col("left"))
    if "n_chars" in columns:
        columns["n_chars"] = F.when(whole, columns["n_chars"]).otherwise(F.length("left").cast(docs.schema["n_chars"].dataType))
    return out.select(*(columns[c].alias(c) for c in docs.columns))


#: The same without runs of any length: shortest windows that count, from each line and to each line, cover all runs.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
u AS (SELECT doc_id, unnest(a) AS line, unnest(range(0, len(a))) AS n FROM d),
l AS (SELECT *, length(line) AS chars, CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS upto FROM u),
ends AS (SELECT doc_id, upto, min(n) AS n FROM l GROUP BY ALL),
begins AS (SELECT doc_id, upto - chars AS below, max(n) AS n FROM l GROUP BY ALL),
f AS (SELECT l.doc_id, l.n AS s, CASE WHEN l.chars >= {ALONE_CHARS} THEN l.n WHEN ends.n IS NOT NULL THEN greatest(ends.n, l.n + {MIN_LINES - 1}) END AS e
      FROM l ASOF LEFT JOIN ends ON l.doc_id = ends.doc_id AND l.upto - l.chars + {MIN_CHARS} <= ends.upto),
b AS (SELECT l.doc_id, CASE WHEN l.chars >= {ALONE_CHARS} THEN l.n WHEN begins.n IS NOT NULL THEN least(begins.n, l.n - {MIN_LINES - 1}) END AS s, l.n AS e
      FROM l ASOF LEFT JOIN begins ON l.doc_id = begins.doc_id AND l.upto - {MIN_CHARS} >= begins.below),
w AS (SELECT * FROM f UNION SELECT * FROM b),
c AS (SELECT w.doc_id, s, e, array_to_string(a[s + 1:e + 1], chr(10)) AS run FROM w JOIN d ON w.doc_id = d.doc_id WHERE s >= 0 AND e < len(a)),
r AS (SELECT *, row_number() OVER (PARTITION BY run, e - s ORDER BY doc_id, s) AS k FROM c),
g AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS n FROM r WHERE k > 1),
x AS (SELECT l.doc_id, l.n, l.line, g.n IS NOT NULL AS gone, lag(g.n IS NOT NULL, 1, false) OVER (PARTITION BY l.doc_id ORDER BY l.n) AS before
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.n = g.n)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE gone AND NOT before) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""
