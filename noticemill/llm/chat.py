"""Chat formatting of typed content parts.

A visitor turns each part of a turn into a piece: text is escaped, an image, an audio or a document part becomes a
placeholder, with its reference and the tokens it will expand to. Pieces are rows, with their places in the formatted
conversation as running sums, so that a conversation of any length streams through a task and is never held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What stands around a turn, and what attachments count for.

    Control strings never occur inside an escaped text: each loses its meaning by an escape after its first character, and
    escapes are doubled. Where a text ends within a control string it is escaped, too, as another text may go on there.
    That needs control strings without escapes in them, and none that begins in what stands around texts, which is checked.
    """

    begin: str = "<s>[INST] "
    middle: str = " [/INST] "
    end: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|image|>", "<|audio|>", "<|document|>", "<|attachment|>")
    trained: tuple[str, ...] = ("assistant",)
    patch: int = 28  # pixels of an image token's side
    audio_tokens: float = 25.0  # a second
    page_tokens: int = 1024

    def __post_init__(self):
        around = [self.begin, self.middle, self.end, *self.controls]
        for c in self.controls:
            if len(c) < 2 or ESCAPE in c:
                raise ValueError(f"not a control string: {c!r}")
            if any(x.endswith(c[:i]) or x.startswith(c[i:]) for i in range(1, len(c)) for x in around):
                raise ValueError(f"{c!r} could come about at either end of a text")
        if not any(c in self.end for c in self.controls) or not any(c in self.middle for c in self.controls):
            raise ValueError("middle and end need a control string")


def _pattern(template: Template) -> str:
    """An escape, or the first character of a control string that the text holds or breaks off in, as group 1."""
    ends = lambda c: "|".join([re.escape(c[1:]), *(re.escape(c[1:i]) + r"\z" for i in range(1, len(c)))])
    return rf"(\\|{'|'.join(f'{re.escape(c[0])}(?={ends(c)})' for c in template.controls)})"


def escaped(text: Column, template: Template = Template()) -> Column:
    """Null text counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _pattern(template), r"$1\\")


def unescaped(text: str) -> str:
    r"""What escaped() was given: \\ is \, and any other \ goes."""
    return re.sub(r"\\(\\?)", r"\1", text)


def _visit(part: Column, t: Template) -> Column:
    """Struct of a part's kind, its piece of the text, its reference and the tokens it expands to."""
    tiles = F.ceil(F.greatest(part["width"], F.lit(1)) / t.patch) * F.ceil(F.greatest(part["height"], F.lit(1)) / t.patch)
    kinds = {
        "image": ("<|image|>", tiles),
        "audio": ("<|audio|>", F.ceil(F.greatest(part["seconds"], F.lit(0.0)) * t.audio_tokens)),
        "document": ("<|document|>", F.greatest(part["pages"], F.lit(1)) * t.page_tokens),
    }
    of = lambda piece, ref, tokens: F.struct(part["type"].alias("kind"), piece.alias("body"), ref.alias("ref"), tokens.cast("long").alias("tokens"))
    none = F.lit(None).cast("string")
    out = F.when(F.coalesce(part["type"], F.lit("text")) == "text", F.struct(F.lit("text").alias("kind"), escaped(part["text"], t).alias("body"), none.alias("ref"), F.lit(0).cast("long").alias("tokens")))
    for kind, (mark, tokens) in kinds.items():
        out = out.when(part["type"] == kind, of(F.lit(mark), part["ref"], tokens))
    return out.otherwise(of(F.lit("<|attachment|>"), part["ref"], F.lit(0)))


def text_parts(text: Column) -> Column:
    """A plain text as the only part of its turn."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages")))


def formatted(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each part of turns (conv_id, turn, role, parts as array of PART), partitioned by conversation.

    conv_id, place (of the turn, from 1), part (from 0), role, kind, piece (its stretch of the formatted text, turn marks
    included), at (code points of the conversation before it), start and stop (of the part's own body), loss (whether
    it is under the loss mask: text of a trained role), ref and tokens (of attachments). Pieces joined in the order of
    place and part are the formatted conversation.

    Turns go by turn, role and parts; nulls come first, repeated rows stay. A null role is empty, a turn with null or no
    parts has one empty text, a null part is an empty text. Rows without conv_id are one conversation. Attachments
    of unknown type get a placeholder of their own and no tokens; an unknown size counts as one pixel, no time or one page.
    Other columns are left out; an empty table gives no rows.
    """
    t = template
    empty = F.array(F.struct(F.lit("text").alias("kind"), F.lit("").alias("body"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens")))
    visited = F.transform("parts", lambda p: _visit(p, t))
    within = Window.partitionBy("conv_id")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.col("parts").cast(f"array<{PART}>").alias("parts")).repartition("conv_id")
    rows = rows.withColumn("place", F.row_number().over(within.orderBy("turn", "role", "parts")))
    rows = rows.select("conv_id", "place", "role", F.posexplode_outer(F.when(F.size("parts") > 0, visited).otherwise(empty)).alias("part", "x"), F.greatest(F.size("parts"), F.lit(1)).alias("parts"))
    head = F.when(F.col("part") == 0, F.concat(F.lit(t.begin), escaped(F.col("role"), t), F.lit(t.middle))).otherwise(F.lit(""))
    tail = F.when(F.col("part") == F.col("parts") - 1, F.lit(t.end)).otherwise(F.lit(""))
    rows = rows.select("conv_id", "place", "part", "role", "x.*", F.length(head).alias("lead"), F.length("x.body").alias("own"), F.concat(head, F.col("x.body"), tail).alias("piece"))
    before = F.sum(F.length("piece").cast("long")).over(within.orderBy("place", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("at", before - F.length("piece"))
    start = F.col("at") + F.col("lead")
    loss = F.col("role").isin(*t.trained) & (F.col("kind") == "text")
    return rows.select("conv_id", "place", "part", "role", "kind", "piece", "at", start.alias("start"), (start + F.col("own")).alias("stop"), loss.alias("loss"), "ref", "tokens")


def assembled(pieces: DataFrame) -> DataFrame:
    """conv_id, text, loss (spans), attachments, tokens: each conversation as one row, for those that fit one (2 GB)."""
    row = F.struct("place", "part", "piece", "start", "stop", "loss", "kind", "ref", "tokens")
    got = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["loss"] & (x["stop"] > x["start"])), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    attached = F.transform(F.filter("p", lambda x: x["kind"] != "text"), lambda x: F.struct(x["place"].alias("turn"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["start"].alias("at"), x["tokens"].alias("tokens")))
    return got.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"), spans.alias("loss"), attached.alias("attachments"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"


class _Reader:
    """Reads one conversation back from its pieces as they come."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars, self.attachments, self.tokens = conv_id, 0, 0, 0, 0, 0
        self.said, self.learned = hashlib.sha256(), hashlib.sha256()

    def read(self, piece: str, at: int, start: int, stop: int, loss: bool, kind: str, tokens: int, t: Template) -> None:
        if at != self.chars:
            raise ValueError(f"conversation {self.conv_id}: a piece at {at} after {self.chars} characters")
        body = piece
        if body.startswith(t.begin):
            role, body = body[len(t.begin) :].split(t.middle, 1)
            self.said.update(f"{unescaped(role)}\n".encode())
        ends = body.endswith(t.end)
        body = body[: len(body) - len(t.end)] if ends else body
        self.said.update((unescaped(body) + ("\n" if ends else "")).encode())
        self.turns += ends
        if loss:
            text = unescaped(piece[start - at : stop - at])
            self.learned.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(piece)
        self.attachments += kind != "text"
        self.tokens += tokens

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.said.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars, self.attachments, self.tokens


def read_back(pieces: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of each conversation, read from the formatted text and its mask; pieces as formatted() gives them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv_id, *piece in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    done += [now.row()] if now is not None else []
                    now = _Reader(conv_id)
                now.read(*piece, template)
            if done:
                yield _digests(done)
                done = []
        if now is not None:
            yield _digests([now.row()])

    order = pieces.sortWithinPartitions("conv_id", "place", "part")
    return order.select(F.col("conv_id").cast("long"), "piece", "at", "start", "stop", "loss", "kind", "tokens").mapInArrow(read, DIGEST)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in DIGEST.split(", ")]
    kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def chat_digests(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and attachments of plain conversations.

    conversations has conv_id, turn, role, text; odd rows go as formatted() says.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", text_parts(F.col("text")).alias("parts"))
    return read_back(formatted(turns, template), template)


def _sql_escapes(text: str, t: Template) -> str:
    """How many escapes a text gets."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    inside = [f"(len({text}) - len(replace({text}, {quoted(c)}, ''))) // {len(c)}" for c in (ESCAPE, *t.controls)]
    tails = sorted({c[:i] for c in t.controls for i in range(1, len(c))})
    return " + ".join(inside) + f" + CASE WHEN {' OR '.join(f'suffix({text}, {quoted(x)})' for x in tails)} THEN 1 ELSE 0 END"


def oracle_sql(control_turns: list[tuple[int, int, str, str]], t: Template = Template()) -> str:
    """Digests of the turns themselves, lengths of the formatted text by counting what is escaped."""
    more = ", ".join(f"({c}, {n}, '{role}', '{text}')" for c, n, role, text in control_turns)
    around = len(t.begin) + len(t.middle) + len(t.end)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {more}) x(conv_id, turn, role, text))),
e AS (SELECT *, len(text) + {_sql_escapes("text", t)} + len(role) + {_sql_escapes("role", t)} + {around} AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' {order})) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (WHERE role IN ({", ".join(f"'{r}'" for r in t.trained)})), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' {order}) FILTER (WHERE role IN ({", ".join(f"'{r}'" for r in t.trained)})), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens
FROM e GROUP BY conv_id
"""
