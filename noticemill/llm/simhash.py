"""SimHash near-dedup: 64-bit fingerprints of word shingles, joined by a grid over per-segment bit counts.

Two fingerprints that differ in d bits have per-segment bit counts at Manhattan distance d at most. So a pair
within 2 bits has a common cell among the cells at distance 0 or 1 from each: every fingerprint is put into
those 33 cells (16 segments of 4 bits), cells are joined by equality and each pair is verified exactly. A cell
with more than dense_cell fingerprints is refined to segments of one bit, where a cell is a 64-bit value, holds
65 fingerprints at most, and all of them lie within 2 bits of each other. Nothing is dropped by the refinement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, line_hash

SHINGLE = 3
SEED = 42
DENSE_CELL = 32
_BLOCK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """Unsigned fingerprint of UTF-8 text: a bit is set if it is set in over half of the shingles' hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    buf, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        h = np.array([digest(buf[s:e], SEED) for s, e in zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])


def fingerprint_links(distinct: DataFrame, dense_cell: int = DENSE_CELL) -> DataFrame:
    """Links (u, v) of ids whose distinct fingerprints fp differ in 2 bits or fewer, enough of them to connect all such."""
    keep = Scratch(distinct.sparkSession).keep
    # the sum of the four bits of each segment, one hexadecimal digit each
    digit = " + ".join(f"(shiftrightunsigned(fp, {i}) & 1229782938247303441L)" for i in range(4))
    cells = distinct.withColumn("c", F.expr(digit))
    around = F.array(F.col("c"), *(F.col("c") + F.lit(s << (4 * i)) for i in range(16) for s in (1, -1)))
    cells = cells.select("id", "fp", F.explode(around).alias("cell"))
    sizes = keep(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))
    found = cells.join(sizes.where(F.col("n") <= dense_cell), "cell").select("cell", "id", "fp")
    a, b = found.alias("a"), found.alias("b")
    sparse = a.join(b, "cell").where("a.fp < b.fp and bit_count(a.fp ^ b.fp) <= 2").selectExpr("a.id as u", "b.id as v")
    hot = cells.join(sizes.where(F.col("n") > dense_cell), "cell", "left_semi").select("id", "fp").distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.expr(f"shiftleft(1L, {i})")) for i in range(64)))
    fine = hot.select("id", F.explode(flips).alias("cell"))
    first = fine.groupBy("cell").agg(F.min("id").alias("v"), F.count("*").alias("n")).where("n > 1")
    dense = fine.join(first, "cell").select(F.col("id").alias("u"), "v")
    return sparse.union(dense)


def simhash_groups(docs: DataFrame, dense_cell: int = DENSE_CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links) of each row of docs.

    Links are between fingerprints, so copies never pair up: they share one fingerprint and join its class.
    A null, empty or blank text has fingerprint zero and links like any other; an empty table gives no rows;
    rows that repeat a doc_id come back as often; other columns of docs are not read.
    """
    keep = Scratch(docs.sparkSession).keep
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    marks = keep(texts.mapInArrow(_fingerprints, "doc_id long, fp long"))
    distinct = keep(marks.groupBy("fp").agg(F.min("doc_id").alias("id")))
    groups = components(fingerprint_links(distinct, dense_cell))
    classes = keep(
        distinct.join(groups, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    )
    return marks.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, dense_cell: int = DENSE_CELL) -> DataFrame:
    """One row of docs of each group of near copies, one of the smallest doc_id; columns unchanged.

    Groups are of fingerprints, so rows without doc_id and rows that share one are grouped by their texts too. A row
    without doc_id stays only in a group where none has one, and one row of it.
    """
    keep = Scratch(docs.sparkSession).keep
    first, second = line_hash(F.col("text").cast("binary"))
    version = F.struct(first.alias("a"), second.alias("b"))  # texts of one version are taken for one, so 128 bits
    texts = docs.select(version.alias("doc_id"), F.col("text").cast("binary").alias("text"))
    marks = texts.mapInArrow(_fingerprints, "doc_id struct<a:bigint,b:bigint>, fp long").groupBy(F.col("doc_id").alias("version")).agg(F.min("fp").alias("fp"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), version.alias("version"))
    rows = docs.select(place.alias("place")).groupBy("place.version").agg(F.min("place").alias("place"))
    marks = keep(marks.join(rows, "version").groupBy("fp").agg(F.min("place").alias("place")))
    groups = components(fingerprint_links(keep(marks.select(F.col("fp").alias("id"), "fp")), dense_cell)).select(F.col("id").alias("fp"), "component")
    kept = marks.join(groups, "fp", "left").groupBy(F.coalesce("component", "fp")).agg(F.min("place").alias("place"))
    kept = keep(kept.select(F.col("place.id").alias("id"), F.col("place.version").alias("version")))
    own = docs.select(F.col("doc_id").cast("long").alias("own_id"), version.alias("own_version"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    own = own.join(kept, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_version") == F.col("version")), "left_semi")
    return own.dropDuplicates(["own_id", "own_version"]).select("row.*")
