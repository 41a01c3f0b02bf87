"""Suffix-array dedup: maximal repeats of byte strings, and removal of what an earlier document has.

A window of MIN_BYTES bytes belongs to the block of its least GRAM-byte hash, so equal windows meet in one block,
wherever they stand. Strings of GRAM bytes that a sample finds in many documents count as greater than all others, so
that a phrase which stands in many texts between different words doesn't bring all of them into one block: only windows
without any rarer string go by it, and these are copies. Documents first exchange these hashes alone; only text around hashes that two documents share is
sent on, as runs of windows with one least hash. A maximal repeat within a block begins at an open window: one whose
copies differ on their left, or of which a copy begins its run. The suffixes from these windows (each reaches to the
end of its run) are sorted, the longest common prefixes of neighbours found and their intervals scanned with a stack;
intervals whose left bytes differ are the maximal repeat groups, each with all its occurrences. In drop_repeats every
occurrence in a document other than the group's least goes; a repeat that runs through several blocks goes in pieces
that overlap. For whole repeats (repeat_groups) all runs are sent; the texts from windows whose copies differ on their
left are then sorted whole. What many documents of a task share is settled in the task: a string is sent once from it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_BYTES = 50
GRAM = 20
#: Bytes of text for each block, which a task holds whole; there are four blocks a partition at least.
BLOCK_BYTES = 4_000_000
_SPAN = MIN_BYTES - GRAM + 1  # windows that one string of GRAM bytes lies in
#: Frequent strings are found in a share of the documents of so many bytes at most, as those of so many of them or more;
#: the most frequent ones, so many at most, are told to all tasks. Only what meets where depends on it, no result.
SAMPLE_SHARE, SAMPLE_BYTES, SAMPLE_DOCS, MOST_FREQUENT = 1 / 16, 256_000_000, 20, 200_000
_MARKS = 1 << 22  # places of a table of frequent hashes; another hash that falls on a marked place counts as frequent, too
_SAMPLE_TASK_BYTES = 8_000_000
_FLUSH_ENTRIES = 2_000_000
_FLUSH_BYTES = 32_000_000
_TABLE = np.random.default_rng(4).integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _rolling(x: np.ndarray, size: int) -> np.ndarray:
    """A hash of each string of size bytes in x, by doubling."""
    out, taken = None, 0
    part, width = _TABLE[x], 1
    while True:
        if size & width:
            n = len(x) - size + 1
            own = part[taken : taken + n]
            out = own.copy() if out is None else out * np.uint64(pow(_BASE, width, 1 << 64)) + own
            taken += width
        if taken == size:
            break
        part = part[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + part[width:]
        width *= 2
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def least_hashes(x: np.ndarray, min_bytes: int = MIN_BYTES, frequent: np.ndarray | None = None) -> np.ndarray:
    """The least hash of the GRAM-byte strings in each window of min_bytes bytes, those marked as frequent after all others."""
    h, span, width = _rolling(x, GRAM), min_bytes - GRAM + 1, 1
    if frequent is not None:
        h = (h >> np.uint64(1)) | (frequent[(h & np.uint64(_MARKS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(63))
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (span - width)], h[span - width :]) if span > width else h


def _runs(x: np.ndarray, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, window after the last, hash) of each run of windows with one least hash.

    Periodic texts, in which that string comes again and again, are cut so that no run has more windows than others.
    """
    low = least_hashes(x, frequent=frequent)
    edges = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    size = np.diff(np.append(edges, len(low)))
    if size.max() > _SPAN:
        offset = np.arange(len(low)) - np.repeat(edges, size)
        edges = np.flatnonzero(offset % _SPAN == 0)
    return edges, np.append(edges[1:], len(low)), low[edges]


def _groups(order_key: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], order_key[1:] != order_key[:-1]))[: len(order_key)])


_EXCHANGE = "part long, hashes binary, docs binary, back binary"


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): hashes of strings that several documents of a task hold, and in how many."""
    own = [np.unique(_rolling(np.frombuffer(text.as_buffer(), np.uint8), GRAM)) for batch in batches for text in batch.column(0) if len(text.as_py() or b"") >= GRAM]
    if own:
        gram, n = np.unique(np.concatenate(own), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(gram[n > 1].view(np.int64)), pa.array(n[n > 1])], ["gram", "n"])


def frequent_marks(own: DataFrame, total: int) -> np.ndarray:
    """The table of frequent hashes of texts with total bytes."""
    share = min(SAMPLE_SHARE, SAMPLE_BYTES / max(1, total))
    sample = own.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 24)) < int(share * (1 << 24))).select("text")
    tasks = max(1, round(share * total / _SAMPLE_TASK_BYTES))
    counts = sample.repartition(tasks).mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= SAMPLE_DOCS).orderBy(F.desc("n"), "gram").limit(MOST_FREQUENT).select("gram")
    marks = np.zeros(_MARKS, bool)
    marks[np.array([r["gram"] for r in found.collect()], np.int64) & (_MARKS - 1)] = True
    return marks


def _anchors(blocks: int, frequent: Broadcast):
    """The least hashes of a task's documents, packed by block. back: whether the document still waits for the answer."""

    def pack(hashes: list[np.ndarray], docs: list[int]) -> Iterator[pa.RecordBatch]:
        if not hashes:
            return
        doc = np.repeat(np.array(docs, np.int64), [len(h) for h in hashes])
        value = np.concatenate(hashes)
        order = np.lexsort((doc, value))
        value, doc = value[order], doc[order]
        at = _groups(value)
        size = np.diff(np.append(at, len(value)))
        shared = doc[at] != doc[at + size - 1]
        member = np.repeat(shared, size)
        first = np.zeros(len(value), bool)
        first[at] = True
        rows = []
        # settled here: its documents get it back at once, dealt by document
        own = np.flatnonzero(member)
        for part, some in _by_block(doc[own].astype(np.uint64), blocks):
            rows.append((-1 - part, value[own[some]], doc[own[some]], np.ones(len(some), bool)))
        sent = np.flatnonzero(first)
        sent = sent[np.argsort(doc[sent], kind="stable")]  # equal and close doc_ids together, for compression
        for part, some in _by_block(value[sent], blocks):
            rows.append((part, value[sent[some]], doc[sent[some]], ~member[sent[some]]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (1, 2, 3))],
            ["part", "hashes", "docs", "back"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, total = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(text.as_buffer() or b"", np.uint8)
                if len(x) >= MIN_BYTES:
                    hashes.append(np.unique(_runs(x, frequent.value)[2]))
                    docs.append(doc)
                    total += len(hashes[-1])
                if total > _FLUSH_ENTRIES:
                    yield from pack(hashes, docs)
                    hashes, docs, total = [], [], 0
        yield from pack(hashes, docs)

    return work


def _by_block(value: np.ndarray, blocks: int) -> Iterator[tuple[int, np.ndarray]]:
    block = (value % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    at = _groups(block[order])
    for a, b in zip(at, np.append(at[1:], len(order))):
        yield int(block[order[a]]), order[a:b]


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(part, columns) of each part of rows that are sorted by it."""
    part, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for k, row in zip(columns[0], zip(*columns[1:])):
            if k != part and held:
                yield part, [list(c) for c in zip(*held)]
                held = []
            part = k
            held.append(row)
    if held:
        yield part, [list(c) for c in zip(*held)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, hash) for each document that waits, where the hash is in two documents or more."""
    for part, (hashes, docs, back) in _collected(batches):
        value = np.frombuffer(b"".join(hashes), np.uint64)
        doc = np.frombuffer(b"".join(docs), np.int64)
        wait = np.frombuffer(b"".join(back), bool)
        if part >= 0:
            order = np.argsort(value, kind="stable")
            value, doc, wait = value[order], doc[order], wait[order]
            at = _groups(value)
            size = np.diff(np.append(at, len(value)))
            known = np.minimum.reduceat(wait, at) == 0  # settled in some task
            several = (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)) | known
            keep = np.repeat(several, size) & wait
            value, doc = value[keep], doc[keep]
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(value.view(np.int64))], ["doc_id", "hash"])


_SEGMENTS = "part long, content binary, sizes binary, docs binary, starts binary, lefts binary"
_RANGES = "doc_id long, first long, last long"


def _segments(blocks: int, settle: bool = True, every: bool = False, frequent: Broadcast | None = None):
    """Runs of windows whose least hash is shared, packed by block.

    If settle, a string goes out for its least document in the task alone: the others' windows are known to go.
    If every, all runs go out, so that repeats within one document meet too.
    """

    def pack(found: dict[bytes, list[tuple[int, int, int, int]]]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        sent: dict[int, list[tuple[bytes, int, int, int]]] = {}
        for content, places in found.items():
            least = min(p[0] for p in places) if settle else None
            for doc, start, part, left in places:
                if not settle or doc == least:
                    sent.setdefault(part, []).append((content, doc, start, left))
                else:
                    sent.setdefault(-1 - doc % blocks, []).append((content, doc, start, left))
        rows = []
        for part, own in sent.items():
            content, doc, start, left = zip(*own)
            numbers = ((list(map(len, content)), np.int32), (doc, np.int64), (start, np.int32), ((left if not settle else ()), np.int16))
            text = b"".join(content) if part >= 0 else b""
            rows.append((part, *(squeeze(x) for x in (text, *(np.array(c, kind).tobytes() for c, kind in numbers)))))
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], [c.split()[0] for c in _SEGMENTS.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list[tuple[int, int, int, int]]] = {}
        total = 0
        for batch in batches:
            for doc, text, hashes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw = text.as_py()
                if (not every and hashes.as_py() is None) or len(raw) < MIN_BYTES:
                    continue
                first, end, value = _runs(np.frombuffer(raw, np.uint8), frequent.value if frequent else None)
                if every:
                    own = np.arange(len(value))
                else:
                    shared = np.sort(hashes.values.to_numpy().view(np.uint64))
                    place = np.minimum(np.searchsorted(shared, value), len(shared) - 1)
                    own = np.flatnonzero(shared[place] == value)
                parts = (value[own] % np.uint64(blocks)).astype(np.int64).tolist()
                for a, b, part in zip(first[own].tolist(), end[own].tolist(), parts):
                    b += MIN_BYTES - 1
                    found.setdefault(raw[a:b], []).append((doc, a, part, raw[a - 1] if a else -1))
                    total += b - a
                if total > _FLUSH_BYTES:
                    yield from pack(found)
                    found, total = {}, 0
        yield from pack(found)

    return work


def enhanced_suffix_array(data: np.ndarray, starts: np.ndarray, reach: np.ndarray, depth: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes of data at starts, each reach bytes long, by their first 8 * depth bytes.

    lcp[i] is the longest common prefix of the suffixes order[i - 1] and order[i], lcp[0] is 0.
    """
    padded = np.concatenate((data, np.zeros(8 * depth + 8, np.uint8)))
    n = len(data) + 8 * depth
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + n]
    masks = np.array([(0xFFFFFFFFFFFFFFFF << (8 * (8 - k))) & 0xFFFFFFFFFFFFFFFF for k in range(9)], np.uint64)
    words = [eight[starts + 8 * j] & masks[np.clip(reach - 8 * j, 0, 8)] for j in range(depth)]
    order = np.lexsort((reach, *words[::-1]))
    lcp = np.full(len(starts), 8 * depth, np.int64)
    for j in range(depth - 1, -1, -1):
        sorted_word = words[j][order]
        differ = sorted_word[1:] ^ sorted_word[:-1]
        zeros = sum((differ < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
        lcp[1:] = np.where(differ != 0, 8 * j + zeros, lcp[1:])
    own = reach[order]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(own[1:], own[:-1]))
    lcp[:1] = 0
    return order, lcp


@dataclass
class Intervals:
    """Intervals of common prefixes: length, first and end in the suffix order, parent or -1; top: the deepest over each border."""

    length: np.ndarray
    first: np.ndarray
    end: np.ndarray
    parent: np.ndarray
    top: np.ndarray

    def over(self, values: np.ndarray, reduce: np.ufunc) -> np.ndarray:
        """reduce over the values of each interval's suffixes, in suffix order."""
        if not len(self.length):
            return values[:0]
        return reduce.reduceat(np.append(values, values[-1:]), np.stack((self.first, self.end), axis=1).ravel())[::2]

    def deepest(self, lcp: np.ndarray) -> np.ndarray:
        """The deepest interval of each suffix, or -1."""
        after = np.append(lcp[1:], 0)
        return np.where(lcp >= after, self.top[:-1], self.top[1:])


def interval_tree(lcp: np.ndarray, least: int) -> Intervals:
    """The intervals of common prefixes of least bytes or more, by a scan with a stack."""
    stack: list[tuple[int, int]] = []  # length, number
    length: list[int] = []
    first: list[int] = []
    at = np.flatnonzero(lcp >= least)
    top = np.full(len(lcp) + 1, -1, np.int64)
    tops: list[int] = []
    end, parent = [], []
    last = -1
    for i, depth in zip(at.tolist(), lcp[at].tolist()):
        if i != last + 1:  # between, nothing is shared
            for _, n in stack:
                end[n] = last + 1
            stack.clear()
        begin, below = i - 1, -1
        while stack and stack[-1][0] > depth:
            _, below = stack.pop()
            end[below], begin = i, first[below]
        if not stack or stack[-1][0] < depth:
            n = len(length)
            length.append(depth)
            first.append(begin)
            end.append(-1)
            parent.append(stack[-1][1] if stack else -1)
            stack.append((depth, n))
        if below >= 0:
            parent[below] = stack[-1][1]
        tops.append(stack[-1][1])
        last = i
    for _, n in stack:
        end[n] = last + 1
    top[at] = tops
    return Intervals(*(np.array(x, np.int64) for x in (length, first, end, parent)), top)


def maximal_repeats(data: np.ndarray, starts: np.ndarray, reach: np.ndarray, lefts: np.ndarray, least: int = MIN_BYTES, depth: int = 10) -> tuple[np.ndarray, np.ndarray, Intervals, np.ndarray]:
    """(order, lcp, intervals, diverse): repeats that neither side can be extended on are the diverse intervals.

    Their left bytes differ or are unknown, below 0. Suffixes reach 8 * depth bytes at most, as those of runs do.
    """
    order, lcp = enhanced_suffix_array(data, starts, reach, depth)
    tree = interval_tree(lcp, least)
    low, high = (tree.over(lefts[order], f) for f in (np.minimum, np.maximum))
    return order, lcp, tree, (low != high) | (low < 0)


def _unpacked(columns: list[list[bytes]]) -> list[np.ndarray]:
    """Text as bytes, sizes, docs, starts and left bytes of rows of _SEGMENTS."""
    expand = zstandard.ZstdDecompressor().decompress
    kinds = (np.uint8, np.int32, np.int64, np.int32, np.int16)
    whole = [np.frombuffer(b"".join(map(expand, c)), k) for c, k in zip(columns, kinds)]
    return [whole[0], *(x.astype(np.int64) for x in whole[1:])]


def _suffixes(columns: list[list[bytes]]):
    """(data, docs, starts, lefts, run of each suffix, its place, its reach) of a block.

    A block of 2^31 bytes or more, which one string in very many documents can make, is an error, not a wrong result.
    """
    data, size, doc, start, left = _unpacked(columns)
    if len(data) >= 1 << 31:
        raise ValueError(f"a block of {len(data)} bytes: 2^31 or more are not supported")
    windows = size - (MIN_BYTES - 1)
    run = np.repeat(np.arange(len(size), dtype=np.int32), windows)
    begin = (np.cumsum(size) - size).astype(np.int32)  # a block has fewer than 2^31 bytes
    offset = (np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.int32)
    return data, doc, start, left, run, begin[run] + offset, size.astype(np.int32)[run] - offset, offset


def _open(data: np.ndarray, place: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which windows have copies that differ on their left, or of which a left byte is unknown (below 0).

    Copies are told by hash; windows that collide by chance can only become open, never closed.
    """
    name = _rolling(data, MIN_BYTES)[place]
    order = np.argsort(name)
    at = _groups(name[order])
    size = np.diff(np.append(at, len(order)))
    low, high = (f.reduceat(left[order], at) for f in (np.minimum, np.maximum))
    out = np.zeros(len(place), bool)
    out[order] = np.repeat((size > 1) & ((low != high) | (low < 0)), size)
    return out


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, first, last): bytes that an earlier document has, last excluded."""
    for part, columns in _collected(batches):
        if part < 0:
            _, size, doc, start, _ = _unpacked(columns)
            first, last = start, start + size
        else:
            data, docs, starts, _, run, place, reach, offset = _suffixes(columns)
            left = np.where(offset == 0, -1, data[np.maximum(place - 1, 0)].astype(np.int16)).astype(np.int16)
            own = np.flatnonzero(_open(data, place, left))
            run, place, reach, begin, left = run[own], place[own], reach[own], starts[run[own]] + offset[own], left[own]
            order, lcp, tree, diverse = maximal_repeats(data, place, reach, left)
            owner = docs[run][order]
            least = tree.over(owner, np.minimum)
            # each occurrence goes by its deepest group that an earlier document is in
            group = tree.deepest(lcp)
            climbing = np.flatnonzero(group >= 0)
            while len(climbing):
                of = group[climbing]
                climbing = climbing[~(diverse[of] & (owner[climbing] > least[of]))]
                group[climbing] = tree.parent[group[climbing]]
                climbing = climbing[group[climbing] >= 0]
            hit = np.flatnonzero(group >= 0)
            doc, first = owner[hit], begin[order[hit]]
            last = first + tree.length[group[hit]]
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(first), pa.array(last)], ["doc_id", "first", "last"])


_STARTS = "doc_id long, first long, last long, window string, left int"


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes that repeated windows cover, without a window; and the windows whose copies differ on their left."""
    for part, columns in _collected(batches):
        data, docs, starts, lefts, run, place, reach, offset = _suffixes(columns)
        order, lcp = enhanced_suffix_array(data, place, reach)
        roots = np.flatnonzero(lcp < MIN_BYTES)
        size = np.diff(np.append(roots, len(order)))
        left = np.where(offset == 0, lefts[run], data[np.maximum(place - 1, 0)])
        least, most = (f.reduceat(left[order], roots) for f in (np.minimum, np.maximum))
        hit = np.zeros(len(order), bool)
        hit[order] = np.repeat(size > 1, size)
        at = np.flatnonzero(hit)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (run[at[1:]] != run[at[:-1]])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(at))[: len(head)] - 1
        begin = starts[run] + offset
        root = np.repeat(np.arange(len(roots)), size)
        open_ = np.flatnonzero(((size > 1) & ((least != most) | (least < 0)))[root])
        own, window = order[open_], [f"{part}-{k}" for k in root[open_].tolist()]
        rows = (
            (docs[run[at[head]]], begin[at[head]], begin[at[tail]] + MIN_BYTES, [None] * len(head), np.zeros(len(head), np.int64)),
            (docs[run[own]], begin[own], begin[own], window, left[own]),
        )
        for doc, first, last, name, byte in rows:
            columns = (pa.array(doc), pa.array(first), pa.array(last), pa.array(name, pa.string()), pa.array(byte.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "first", "last", "window", "left"])


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text from each such window on, as far as each next window is a repeat."""
    for batch in batches:
        for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            raw, found = text.as_py(), found.as_py()
            alone = np.ones(len(raw) + 2, bool)
            for x in found:
                if x["window"] is None:
                    alone[x["first"] : x["last"] - MIN_BYTES + 1] = False
            ends = np.flatnonzero(alone)
            rows = [(x["window"], doc, x["first"], x["left"], raw[x["first"] : int(ends[np.searchsorted(ends, x["first"])]) - 1 + MIN_BYTES]) for x in found if x["window"] is not None]
            for at in range(0, len(rows), 200):
                columns = zip(*rows[at : at + 200])
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["window", "doc_id", "start", "left", "tail"])


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax()) if differ.any() else n


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for window, (docs, starts, lefts, tails) in _collected(batches):
        order = sorted(range(len(tails)), key=tails.__getitem__)
        lcp = np.array([0] + [_common(tails[a], tails[b]) for a, b in zip(order, order[1:])], np.int64)
        tree = interval_tree(lcp, MIN_BYTES)
        for k, (length, first, end) in enumerate(zip(tree.length.tolist(), tree.first.tolist(), tree.end.tolist())):
            own = order[first:end]
            if len({lefts[i] for i in own}) > 1 or any(lefts[i] < 0 for i in own):
                columns = ([f"{window}-{k}"] * len(own), [length] * len(own), [docs[i] for i in own], [starts[i] for i in own])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["repeat", "length", "doc_id", "start"])


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    # without an alias where none is needed, the two exchanges of the texts are one and the same to the planner
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(doc_id, text.alias("text"))


def _runs_of_shared(own: DataFrame, settle: bool) -> tuple[DataFrame, int]:
    """Rows of _SEGMENTS, dealt and sorted by block, of all documents with a doc_id; the number of partitions."""
    partitions = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(4 * partitions, -(-total // BLOCK_BYTES))
    deal = lambda df: df.repartition(partitions, "part").sortWithinPartitions("part")
    frequent = own.sparkSession.sparkContext.broadcast(frequent_marks(own, total))  # 4 MB
    shared = deal(own.mapInArrow(_anchors(blocks, frequent), _EXCHANGE)).mapInArrow(_shared, "doc_id long, hash long")
    shared = shared.groupBy("doc_id").agg(F.collect_list("hash").alias("hashes"))
    return deal(own.join(shared, "doc_id").select("doc_id", "text", "hashes").mapInArrow(_segments(blocks, settle, frequent=frequent), _SEGMENTS)), partitions


def repeat_groups(docs: DataFrame) -> DataFrame:
    """(repeat, length, doc_id, start): all occurrences of each maximal repeat of MIN_BYTES bytes or more, whole.

    A maximal repeat begins at a window whose copies differ on their left; only from there on is the text sent, as far
    as windows repeat, to where these copies meet. Repeats within one document count. doc_id names a text.
    """
    own = _texts(docs).where("doc_id is not null").dropDuplicates(["doc_id"])
    partitions = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda df, key: df.repartition(partitions, key).sortWithinPartitions(key)
    runs = own.withColumn("hashes", F.lit(None).cast("array<long>")).mapInArrow(_segments(4 * partitions, False, True), _SEGMENTS)
    found = deal(runs, "part").mapInArrow(_starts, _STARTS).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "window", "left")).alias("found"))
    tails = own.join(found, "doc_id").select("doc_id", "text", "found").mapInArrow(_tails, "window string, doc_id long, start long, left int, tail binary")
    return deal(tails, "window").mapInArrow(_repeats, "repeat string, length long, doc_id long, start long")


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, firsts, lasts in zip(batch.column(1), batch.column(2), batch.column(3)):
            raw = text.as_py()
            if firsts.as_py() is None:
                rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            depth = np.zeros(len(raw) + 2, np.int64)
            np.add.at(depth, np.clip(firsts.values.to_numpy(), 0, len(raw)), 1)
            np.add.at(depth, np.clip(lasts.values.to_numpy(), 0, len(raw)), -1)
            gone = np.cumsum(depth)[: len(raw)] > 0
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows)) if rows else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs, its text as UTF-8 bytes.

    A null text counts as empty; a text shorter than MIN_BYTES loses nothing. doc_id names a text: repeated rows come
    back as often and lose the same bytes. Rows without doc_id are compared with none. An empty table gives no rows;
    other columns are not read.
    """
    own = _texts(docs)
    named = own.where("doc_id is not null")
    runs, _ = _runs_of_shared(named, settle=True)
    ranges = runs.mapInArrow(_ranges, _RANGES).groupBy("doc_id").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    done = named.join(ranges, "doc_id", "left").select("doc_id", "text", "firsts", "lasts")
    none = F.lit(None).cast("array<long>")
    rest = own.where("doc_id is null").select("doc_id", "text", none.alias("firsts"), none.alias("lasts"))
    return done.union(rest).mapInArrow(_strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
