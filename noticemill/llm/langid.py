"""Word-first language ID: known words by their log frequency in each language, other words by character n-grams.

A word that was learned scores by its frequency in each language. A word that wasn't backs off: to its known
4-grams, else its known 3-grams, and so on to single characters. A text's score is the sum over its words. Words of a
text aren't independent: if any two of n words agree by r, they tell as much as n / (1 + (n - 1) r) independent ones, so
sums are divided by 1 + (n - 1) r, with the likeliest r for rows that weren't learned from, before they are turned into
the posterior. One word counts in full, and a long text doesn't become certain by its length alone.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About so many labelled rows of each language are learned from, chosen by a hash of doc_id.
ROWS_PER_LANGUAGE = 2500
#: Nor more than about so many bytes of text of each language, which bounds the model where rows are long.
BYTES_PER_LANGUAGE = 64_000_000
LONGEST = 4
#: One in so many rows of the sample is set aside while the agreement of words is found, in languages of so many rows.
CALIBRATING, CALIBRATING_FROM = 10, 20
AGREEMENTS = (0.0, *(2 ** (k / 2) for k in range(-24, 1)))
UNDETERMINED = "und"
#: Scores an executor process remembers, one of each language for a word; only speed depends on it.
REMEMBERED = 1_200_000
#: A model of so many scores is laid out with all languages of each token; only speed depends on it.
DENSE = 8_000_000
#: New words are scored so many at once, by the number of languages; only speed and memory depend on it.
AT_ONCE = 1 << 16
_WORD = re.compile(r"[^\W\d_]+")
_SCALE = 1 << 20


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its borders marked; a single character stands without borders."""
    if n == 1:
        return list(word)
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """A token scores the floor of its length in each language, and more in the languages it was seen in.

    What looks tokens up is laid out when it is first asked for: the driver, which hands the model on, never does.
    """

    languages: list[str]
    lengths: np.ndarray  # a row's token has this length, 0 for a word
    tokens: pa.Array
    floors: np.ndarray  # by length and language
    ends: np.ndarray  # a row's columns and gains end here, and the next row's begin
    columns: np.ndarray
    gains: np.ndarray
    agreement: float = 0.0
    known: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.room = max(1000, REMEMBERED // max(1, len(self.languages)))

    @cached_property
    def by_length(self) -> list[dict[str, int]]:
        """By length, 0 for words: a token to its row. What looks tokens up reads these, as no key has a tuple of its own."""
        out: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        for i, (n, token) in enumerate(zip(self.lengths.tolist(), self.tokens.to_pylist())):
            out[n][token] = i
        return out

    @cached_property
    def rows(self) -> dict[tuple[int, str], int]:
        """The same in one: (0, word) or (n, n-gram) to a row."""
        return {(n, token): i for n, own in enumerate(self.by_length) for token, i in own.items()}

    @cached_property
    def dense(self) -> np.ndarray | None:
        """Each token's scores by row, and behind them room for the words remembered; none if that were too many."""
        if len(self.tokens) * len(self.languages) > DENSE:
            return None
        out = np.zeros((len(self.tokens) + self.room, len(self.languages)))
        np.take(self.floors, self.lengths, axis=0, out=out[: len(self.tokens)], mode="clip")
        out[np.repeat(np.arange(len(self.tokens)), np.diff(self.ends, prepend=0)), self.columns] += self.gains
        return out

    @cached_property
    def learned(self) -> dict[str, int]:
        """The words whose scores are laid out, to their rows."""
        return {} if self.dense is None else self.by_length[0]

    @cached_property
    def cache(self) -> np.ndarray:
        """The scores that texts add up; the last rows are those of the words remembered."""
        return np.zeros((self.room, len(self.languages))) if self.dense is None else self.dense

    def parts(self) -> tuple:
        return self.languages, self.lengths, self.tokens, self.floors, self.ends, self.columns, self.gains, self.agreement

    def found(self, word: str) -> tuple[int, list[int]]:
        """The length that a word is scored by, 0 for its own, and the rows of its known tokens of that length."""
        at = self.by_length[0].get(word)
        if at is not None:
            return 0, [at]
        for n in range(LONGEST, 0, -1):
            known = self.by_length[n].get
            if rows := [i for g in grams_of(word, n) if (i := known(g)) is not None]:
                return n, rows
        return 0, []

    def words(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word: the mean over its known tokens, zeros if none is known."""
        found = [self.found(w) for w in words]
        counts = np.array([len(x) for _, x in found], np.int64)
        rows = np.fromiter(chain.from_iterable(x for _, x in found), np.int64, int(counts.sum()))
        ends = self.ends[rows]
        sizes = ends - np.where(rows > 0, self.ends[rows - 1], 0)
        at = np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        cells = np.repeat(np.repeat(np.arange(len(words)), counts), sizes) * len(self.languages) + self.columns[at]
        sums = np.bincount(cells, self.gains[at], len(words) * len(self.languages)).reshape(len(words), -1)
        out = self.floors[[n for n, _ in found]] + sums / np.maximum(counts, 1)[:, None]
        out[counts == 0] = 0
        return out

    def word(self, word: str) -> np.ndarray:
        return self.words([word])[0]

    def remember(self, words: list[str]) -> list[int]:
        """The rows in the cache of at most as many words as it has room for."""
        if len(self.known) + len(words) > self.room:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        step = max(1, AT_ONCE // len(self.languages))
        for some in (new[i : i + step] for i in range(0, len(new), step)):
            begin = len(self.cache) - self.room + len(self.known)
            self.cache[begin : begin + len(some)] = self.words(some)
            self.known.update(zip(some, range(begin, begin + len(some))))
        return [self.known[w] for w in words]

    def total(self, text: str | None) -> tuple[np.ndarray, int] | None:
        """The sum over the words of a text for each language, and their number; null if it has no letter or nothing was learned."""
        words = words_of(text)
        if not self.languages or not any(c.isalpha() for w in words for c in w):
            return None
        total = np.zeros(len(self.languages))
        for begin in range(0, len(words), self.room):
            some = words[begin : begin + self.room]
            at = np.fromiter(map(self.learned.get, some, repeat(-1)), np.int64, len(some))
            if len(missing := np.flatnonzero(at < 0)):
                at[missing] = self.remember([some[i] for i in missing.tolist()])
            total += self.cache.take(at, axis=0).sum(axis=0)
        return total, len(words)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.total(text)
        if found is None:
            return UNDETERMINED, 0.0
        total, n = found
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp((total - total[best]) / (1 + (n - 1) * self.agreement)).sum())


def build(counts: list[tuple[int, str, str, int]]) -> Model:
    """The model of (length or 0 for a word, token, language, count) rows, add-one smoothed."""
    columns = list(zip(*counts)) if counts else [()] * 4
    kinds = (pa.int32(), pa.string(), pa.string(), pa.int64())
    return _built(pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["n", "token", "lang", "c"]))


def _built(counts: pa.Table) -> Model:
    """The same of a table of n, token, lang, c; no Python object is made of a token."""
    languages = sorted(pc.unique(counts["lang"]).to_pylist())
    own = pc.index_in(counts["lang"], pa.array(languages, pa.string())).to_numpy()
    # a length is one digit before the token
    wide = pa.large_string()
    named = pc.binary_join_element_wise(counts["n"].cast(wide), counts["token"].cast(wide), pa.scalar("", wide))
    named = named.combine_chunks().dictionary_encode()
    row, tokens = named.indices.to_numpy(), pc.utf8_slice_codeunits(named.dictionary, 1)
    n, seen = counts["n"].to_numpy(), counts["c"].to_numpy().astype(np.float64)
    lengths = np.zeros(len(tokens), np.int8)
    lengths[row] = n
    sums = np.zeros((LONGEST + 1, len(languages)))
    np.add.at(sums, (n, own), seen)
    kinds = np.bincount(lengths, minlength=LONGEST + 1)
    order = np.argsort(row, kind="stable")
    ends = np.cumsum(np.bincount(row, minlength=len(tokens)))
    return Model(languages, lengths, tokens, -np.log(np.maximum(sums + kinds[:, None], 1)), ends, own[order].astype(np.int32), np.log1p(seen[order]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts of a partition by language and whether the row is set aside."""
    found: dict[tuple[str, bool], Counter] = defaultdict(Counter)

    def flush() -> pa.RecordBatch:
        columns = lang, aside, n, token, c = [], [], [], [], []
        for key, x in found.items():  # column by column, without a tuple for each row
            lang += [key[0]] * len(x)
            aside += [key[1]] * len(x)
            n += (k[0] for k in x)
            token += (k[1] for k in x)
            c += x.values()
        found.clear()
        kinds = (pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["lang", "aside", "n", "token", "c"])

    for batch in batches:
        for lang, text, aside in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            own = found[lang, aside]
            for word, c in Counter(words_of(text.as_py())).items():
                own[0, word] += c
                for n in range(1, LONGEST + 1):
                    for g in grams_of(word, n):
                        own[n, g] += c
            if sum(map(len, found.values())) > 500_000:
                yield flush()
    yield flush()


def is_held_out() -> Column:
    """Rows that are never learned from: the crc32 of doc_id as text has remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn every token of a sample of the rows that aren't held out, bounded in each language; no language is left out.

    The model comes to the driver and is broadcast: rows_per_language, BYTES_PER_LANGUAGE and the number of languages bound it.
    """
    own = docs.where(~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = own.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    share = F.expr(f"least({_SCALE}, {rows_per_language * _SCALE} div n + 1, {BYTES_PER_LANGUAGE * _SCALE} div greatest(bytes, 1) + 1)")
    sizes = sizes.select(F.col("lang").alias("_lang"), share.alias("_share"), (F.col("n") >= CALIBRATING_FROM).alias("_many"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(_SCALE))
    own = own.select("lang", F.col("text").cast("string").alias("text"), draw.alias("draw"))
    # one row a language, as many as the model on the driver has; a shuffle by so few keys would be one task's work each
    sample = own.join(F.broadcast(sizes), F.col("lang") == F.col("_lang")).where("draw < _share").select("lang", "text", (F.col("_many") & (F.col("draw") % CALIBRATING == 0)).alias("aside"))
    tokens = sample.mapInArrow(_count, "lang string, aside boolean, n int, token string, c long")
    totals = tokens.groupBy("n", "token", "lang").agg(F.sum("c").alias("c"), F.sum(F.when(~F.col("aside"), F.col("c"))).alias("part"))
    counts = totals.toArrow()
    # one model at a time on the driver
    agreement = _agreement(_share(_without(counts), docs), sample.where("aside").select("lang", "text"))
    model = _built(counts)
    model.agreement = agreement
    return model


def _without(counts: pa.Table) -> Model:
    """The model of the rows that aren't set aside."""
    return _built(counts.filter(pc.greater(counts["part"], 0)).drop_columns("c").rename_columns({"part": "c"}))


def _share(model: Model, docs: DataFrame) -> Broadcast:
    """The parts of a model for all tasks; its size is bounded by the row sample."""
    return docs.sparkSession.sparkContext.broadcast(model.parts())


def _learned(docs: DataFrame, model: Model | None) -> Broadcast:
    """The parts of the model, or else of one that is trained; what training leaves with Arrow goes back to the system."""
    shared = _share(train(docs) if model is None else model, docs)
    pa.default_memory_pool().release_unused()
    return shared


def _agreement(shared: Broadcast, rows: DataFrame) -> float:
    """The agreement of words under which the rows' languages are likeliest; 0 if there is no row to tell. It drops the model's parts."""
    pa.default_memory_pool().release_unused()

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        place = {lang: i for i, lang in enumerate(own.languages)}
        loss = np.zeros(len(AGREEMENTS))
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counted = own.total(text.as_py())
                if counted is not None and lang in place:
                    total, n = counted
                    below = (total - total.max()) / (1 + (n - 1) * np.array(AGREEMENTS))[:, None]
                    loss += np.log(np.exp(below).sum(axis=1)) - below[:, place[lang]]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(AGREEMENTS)), pa.int32()), pa.array(loss)], ["r", "loss"])

    found = rows.mapInArrow(losses, "r int, loss double").groupBy("r").agg(F.sum("loss").alias("loss")).collect()  # one row an agreement
    shared.destroy()  # else the driver keeps it until it collects its garbage
    best = min((x for x in found if x.loss > 0), key=lambda x: (x.loss, x.r), default=None)
    return AGREEMENTS[best.r] if best else 0.0


def identify_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs; a prediction reads its text alone.

    lang_pred is a learned lang value, `und` with score 0 if the text is null or has no letter or nothing was
    learned. score is the calibrated posterior of lang_pred among the learned languages. Ties go to the language that sorts
    first. Repeated rows come back as often; an empty table gives no rows; other columns are not read.
    """
    shared = _learned(docs, model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            got = [own.predict(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least_score: float = 0.5, model: Model | None = None) -> DataFrame:
    """The rows of docs whose language is identified with a score of least_score or more; columns unchanged.

    Rows with a null text or one without letters go, as nothing identifies them; repeated rows and rows without doc_id
    are judged by their text alone. Where nothing can be learned no row stays. An empty table gives no rows.
    """
    shared = _learned(docs, model)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            got = [own.predict(x.as_py()) for x in batch.column(place)]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least_score for lang, score in got], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
