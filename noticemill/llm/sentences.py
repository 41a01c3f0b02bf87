"""Substring dedup by sliding sentence spans.

Spans are the runs of MIN_SENTENCES or more consecutive sentences with MIN_WORDS or more words. Every such run is the
union of the shortest ones that begin or end at its sentences, so that these alone are hashed, and what they cover is
what all runs would cover. Spans are joined globally by a 128-bit hash; a sentence goes if a span that covers it stands
in a document with a smaller doc_id, or earlier in its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MIN_SENTENCES = 2
MIN_WORDS = 20
#: A sentence with the white space after it; it ends at a line break, at ., ! or ? before white space, or at a full-width mark.
_SENTENCE = re.compile(r"[^\n.!?。！？।॥؟۔]*(?:[.!?]+(?!\s)[^\n.!?。！？।॥؟۔]*)*(?:[.!?]+\s+|[。！？।॥؟۔]+\s*|\n\s*|[.!?]+\Z|\Z)")
#: Scripts that part no words by spaces; two of their letters count as a word.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")


def sentences(text: str) -> list[str]:
    """The text in pieces; joined they give the text again."""
    return [s for s in _SENTENCE.findall(text) if s]


def spans(parts: list[str]) -> list[tuple[int, int, bytes]]:
    """(first, end, hash) of the shortest spans that begin or end at each sentence, where the text has enough for one."""
    words = [p.split() for p in parts]
    clean = [" ".join(w).encode() for w in words]
    size = list(map(len, words))
    if not all(map(str.isascii, parts)):
        size = [n + len(_UNSPACED.findall(p)) // 2 for n, p in zip(size, parts)]
    sizes = np.cumsum([0] + size)
    n = len(parts)
    ends = np.maximum(np.searchsorted(sizes, sizes[:-1] + MIN_WORDS), np.arange(n) + MIN_SENTENCES)
    firsts = np.minimum(np.searchsorted(sizes, sizes[1:] - MIN_WORDS, side="right") - 1, np.arange(1, n + 1) - MIN_SENTENCES)
    runs = {(i, e) for i, e in enumerate(ends.tolist()) if e <= n} | {(i, e) for e, i in enumerate(firsts.tolist(), 1) if i >= 0}
    digest = xxhash.xxh3_128_digest
    return [(i, e, digest(b" ".join(clean[i:e]))) for i, e in sorted(runs)]


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            ids, found = [], []
            for doc, text in zip(batch.column(0)[at : at + 500].to_pylist(), batch.column(1)[at : at + 500]):
                own = {h for _, _, h in spans(sentences(text.as_py()))}
                ids += [doc] * len(own)
                found += own
            halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(np.ascontiguousarray(h)) for h in halves.T)], ["doc_id", "a", "b"])


def strip_repeats(text: str, known: set[bytes]) -> tuple[str, int, int]:
    """(what is left, sentences, sentences removed), given the hashes of spans that stand in earlier documents."""
    parts = sentences(text)
    gone, seen = np.zeros(len(parts) + 1, np.int64), set()
    for i, e, h in spans(parts):
        if h in known or h in seen:
            gone[i] += 1
            gone[e] -= 1
        seen.add(h)
    out = np.cumsum(gone)[:-1] > 0
    return "".join(p for p, x in zip(parts, out) if not x), len(parts), int(out.sum())


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            rows = []
            for text, *known in zip(part.column(1), part.column(2), part.column(3)):
                halves = np.array([x.as_py() or [] for x in known], np.int64).T.tobytes()
                known = {halves[i : i + 16] for i in range(0, len(halves), 16)}
                left, n, removed = strip_repeats(text.as_py(), known)
                rows.append((n, removed, hashlib.sha256(left.encode()).hexdigest(), left))
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "n_sentences", "n_removed", "kept_sha256", "kept"])


def drop_repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, kept_sha256, kept (the text that is left) of each row of docs.

    A null text counts as empty. White space within a span doesn't count when spans are compared. Of repeated rows, or
    rows that share a doc_id, each is kept as the other's equal: only a smaller doc_id makes a copy. An empty table
    gives no rows; other columns are not read; rows without doc_id are compared with none and keep their text but for
    what repeats in itself.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = own.where("doc_id is not null").mapInArrow(_hashes, "doc_id long, a long, b long")
    first = found.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = Scratch(docs.sparkSession).keep(first.select("a", "b", "first"))
    later = found.join(first, ["a", "b"]).where("doc_id > first").select("doc_id", F.struct("a", "b").alias("span"))
    later = later.groupBy("doc_id").agg(F.collect_set("span").alias("known")).select("doc_id", F.col("known.a").alias("a"), F.col("known.b").alias("b"))
    return own.join(later, "doc_id", "left").select("doc_id", "text", "a", "b").mapInArrow(
        _strip, "doc_id long, n_sentences long, n_removed long, kept_sha256 string, kept string"
    )
