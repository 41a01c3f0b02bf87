"""Byte-level BPE by backtracking: exact merges in linear time, decoding by an offset table.

An Aho-Corasick automaton over all token byte strings gives the longest token at each position of a piece. The
encoder takes it if its pair with the token before is compatible, that is, if merging would never choose another
token across their border; else it tries shorter tokens, and at the last goes back one token. The vocabulary file
is a parameter; nothing of it is stored here.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: Pieces an executor process remembers the tokens of; only speed depends on it.
REMEMBERED = 400_000
#: Fixed value: how byte-level BPE splits a text before any merge.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if visible in Latin-1, else U+0100 onwards."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_of_char()
        ids = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        raw = {i: bytes(to_byte[c] for c in s) for s, i in ids.items()}
        raw |= {i: s.encode() for s, i in self.special.items()}
        table = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for x in table])))
        self.rank: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = ids[a], ids[b], ids[a + b]
            self.merged[x, y] = z
            self.parts.setdefault(z, (x, y))
            self.rank.setdefault(z, rank)
        self.words = {raw[i].decode("latin-1"): i for i in ids.values()}
        self.size = {i: len(raw[i]) for i in ids.values()}
        self.shorter = {}
        for word, i in self.words.items():
            cut = next((n for n in range(len(word) - 1, 0, -1) if word[:n] in self.words), 0)
            self.shorter[i] = self.words[word[:cut]] if cut else None
        self.automaton = ahocorasick.Automaton()
        for word, i in self.words.items():
            self.automaton.add_word(word, (len(word), i))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a border between a and b: undo their merges, latest first, towards the border."""
        first = len(self.merged)
        ranks, parts = self.rank, self.parts
        limit = first
        while True:
            both = self.merged.get((a, b))
            if both is not None and ranks[both] < limit:
                return False
            ra, rb = ranks.get(a, -1), ranks.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, parts[a][1]  # a merge across the border must come before a was made
            else:
                limit, b = rb + 1, parts[b][0]  # of equals the left one is made first

    def piece_ids(self, piece: bytes) -> list[int]:
        text = piece.decode("latin-1")
        n = len(text)
        longest: list[tuple[int, int]] = [(0, -1)] * n
        for end, (size, token) in self.automaton.iter(text):
            at = end - size + 1
            if size > longest[at][0]:
                longest[at] = (size, token)
        out: list[int] = []
        dead: set[int] = set()
        seen, size_of, shorter = self.compatible, self.size, self.shorter
        at, token = 0, longest[0][1]
        while at < n:
            last = out[-1] if out else None
            while token is not None:
                end = at + size_of[token]
                if end not in dead:
                    if last is None:
                        break
                    fits = seen.get((last, token))
                    if fits is None:
                        fits = seen[last, token] = self._compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at = end
                if at < n:
                    token = longest[at][1]
            else:
                dead.add(at)
                token = out.pop()
                at -= size_of[token]
        return out

    def _piece(self, piece: str) -> tuple[bytes, str]:
        ids = self.piece_ids(piece.encode())
        return np.array(ids, "<u4").tobytes(), ",".join(map(str, ids))

    def encode_packed(self, text: str) -> tuple[np.ndarray, str]:
        """Ids as an array and joined by commas."""
        known, find = self.known, self.pieces.findall
        got: list[tuple[bytes, str]] = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                got.append((np.array([self.special[part]], "<u4").tobytes(), str(self.special[part])))
                continue
            for piece in find(part):
                x = known.get(piece)
                if x is None:
                    x = self._piece(piece)
                    if len(piece) <= 64:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        if len(self.compatible) >= REMEMBERED:
                            self.compatible.clear()
                        known[piece] = x
                got.append(x)
        return np.frombuffer(b"".join([x[0] for x in got]), "<u4"), ",".join([x[1] for x in got])

    def encode(self, text: str) -> list[int]:
        return self.encode_packed(text)[0].tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes one after another, gathered from the blob by offsets."""
        if not len(ids):
            return b""
        out = []
        for at in range(0, len(ids), 1 << 18):
            some = ids[at : at + (1 << 18)].astype(np.int64)
            start, size = self.offsets[some], self.offsets[some + 1] - self.offsets[some]
            place = np.cumsum(size) - size
            out.append(self.blob[np.repeat(start - place, size) + np.arange(int(size.sum()))].tobytes())
        return b"".join(out)

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids)).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary at path, read once in a process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs: its text encoded, and the ids decoded again.

    A null text counts as empty: no tokens, the hash of the empty string twice. Rows that repeat come back as often;
    an empty table gives no rows; other columns are not read. The file is opened by each executor process: it is
    part of an installed package there, as pyspark itself is.
    """
    where = path or public_tokenizers.path(VOCABULARY)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = load(where), lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids, joined = bpe.encode_packed(text.as_py() or "")
                decoded = bpe.decode_bytes(ids).decode("utf-8", "replace").encode()
                rows.append((len(ids), sha(joined.encode()), sha(decoded)))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
