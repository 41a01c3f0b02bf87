"""Importance resampling, spelling variants and chat formatting against brute force and round trips."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from noticemill.llm import chat, importance, queries, spelling

SF = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "Sobre a casa e o jardim, nada mais. Ünder É " * 4000


def sha(x) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


ODD = [None, "", " ", "\n\n", "é" * 60, "z" * 49, LONG, LONG, "a\0b", "🎉" * 30, "one two", "$1,000 \\ 'x'"]


# Importance resampling -------------------------------------------------------------------------------------------------


def brute_buckets(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resampled(rows, target, percent=5, least=20):
    own = [(d, *brute_buckets(t)) for d, t in rows]
    s, t = Counter(b for _, _, bs in own for b in bs), Counter(b for x in target for b in brute_buckets(x)[1])
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out = []
    for d, n, bs in own:
        weight = sum(map(gain, bs))
        score = None
        if d is not None:
            h = int(sha(f"42:{d}")[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(bs), weight, score, None, n])
    able = sorted((x for x in out if x[5] >= least and x[0] is not None), key=lambda x: (-x[3], x[0]))
    for i, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = i + 1
    return [tuple(x[:5]) for x in out]


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


def test_resampling_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op11_importance_resampling(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert by_text(got.collect()) == by_text(brute_resampled(rows, target))


@pytest.mark.parametrize("percent", [1, 50, 99, 100])
def test_resampling_of_odd_rows_and_shares(spark, percent):
    rnd = random.Random(percent)
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "alone " * 30), (None, None)] + [(i, " ".join(rnd.choices("Ab ba é1 Cc".split(), k=rnd.choice([19, 20, 40])))) for i in range(100, 400)]
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], TEXTS + ", rank string, score long, n_words long")
    target = spark.createDataFrame([("ab ba",), (None,)], "text string")
    got = importance.resampled(df, target, percent).collect()
    assert by_text(got) == by_text(brute_resampled(rows, ["ab ba", None], percent))


def test_resampling_of_empty_tables_and_copies(spark):
    empty = spark.createDataFrame([], TEXTS)
    some = spark.createDataFrame([(i, "a b c " * 10) for i in range(40)] + [(7, "a b c " * 10)], TEXTS)
    assert importance.resampled(empty, some).count() == 0
    got = importance.resampled(some, empty).collect()
    assert len(got) == 41 and sorted(r.rank for r in got if r.rank) == [1, 2]
    kept = importance.sampled(some, empty)
    assert kept.columns == some.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.rank}


# Spelling variants -----------------------------------------------------------------------------------------------------


def brute_words(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    found = defaultdict(set)
    for a, b in itertools.combinations(n, 2):
        if near(a, b):
            found[a].add(b)
            found[b].add(a)
    form = {}
    for w in found:
        best = min(found[w], key=lambda x: (-n[x], x))
        if n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(found[w]), n[form[w]] if w in form else None) for w in n)


def test_spelling_equals_brute_force(spark, docs):
    want = brute_variants(brute_words([(r.doc_id, r.text) for r in docs.collect()]))
    got = queries.op12_spelling_variants(spark, SF)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert sorted(map(tuple, got.collect())) == want and want


@pytest.mark.parametrize("dense", [2, 20, 10_000])
def test_near_pairs_whatever_the_cells(spark, dense):
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abcé") for _ in range(rnd.randint(6, 8))) for _ in range(250)} | {"aaaaaa" + x for x in "abcdefghijÿ×"} | {"aaaaaa", "aaaaaaaa", "abcdefg", "bcdefgh", "abcdegf"}
    got = [(r.u, r.v) for r in spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), dense).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if a < b and near(a, b)) and len(got) > 100


def test_spelling_chains_ties_and_odd_rows(spark):
    counts = {"abcdef": 3125, "abcdeg": 625, "abcdxg": 125, "abcyxg": 25, "zbcyxg": 5, "mmmmmm": 30, "mmmmmn": 30, "mmmmmo": 6, "ÀÀÀÀÀÀ": 50, "àÀÀÀÀÀ": 5}
    rows = [(i, f"{w} {w.upper() if w.isascii() else w}, " * (k // 2) + w * (k % 2)) for i, (w, k) in enumerate(counts.items())] + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "kkkkkk " * 6), (None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TEXTS + ", word string, n long")
    got = sorted(map(tuple, spelling.spelling_variants(df).collect()))
    want = brute_variants(brute_words(rows))
    assert got == want and any(r[2] == "abcdef" and r[0] == "zbcyxg" for r in want)
    assert spelling.spelling_variants(spark.createDataFrame([], TEXTS)).count() == 0


# Chat formatting -------------------------------------------------------------------------------------------------------


def brute_digests(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(learned), sha(learned))
    return out


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_chat_format(spark, SF)
    assert digests(got) == brute_digests([*rows, *queries.CONTROL_TURNS])
    assert all(r.formatted_chars > r.loss_chars for r in got.collect())


STRANGE = ["</s>", "<s>[INST] ok [/INST]", "\\", "\\\\", "<\\/s>", "\\</s>\\", "<", "[", "[/INST", "<|image|>", "<|ima", "]", "🎉é\n", "", "<<s>>", "[[INST]]", "</s></s>"]


def test_chat_round_trip_of_strange_texts(spark):
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "<s>[INST] "]), rnd.choice([None, "".join(rnd.choices(STRANGE, k=rnd.randint(0, 6)))])) for c in [*range(40), None] for t in [None, 0, 1, 1, 2]]
    rows += [(50, 0, "assistant", LONG), (50, 0, "assistant", LONG)] + [(51, i, "user", "x") for i in range(500)]
    df = spark.createDataFrame([(*r, "y") for r in rows], "conv_id long, turn long, role string, text string, parts string")
    assert digests(chat.chat_digests(df)) == brute_digests(rows)
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_escapes_leave_no_control_string_and_are_undone(spark):
    t, rnd = chat.Template(), random.Random(6)
    texts = ["".join(rnd.choices([*STRANGE, "s>", "/", "INST]", "|>"], k=rnd.randint(0, 8))) for _ in range(3000)]
    got = [r.e for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(chat.escaped(F.col("x"), t).alias("e")).collect()]
    for x, e in zip(texts, got):
        assert chat.unescaped(e) == x and not any(c in e for c in t.controls)
    for a, b in itertools.pairwise(range(len(texts))):  # two texts side by side
        assert chat.unescaped(got[a] + got[b]) == texts[a] + texts[b] and not any(c in got[a] + got[b] for c in t.controls)
    for bad in ({"controls": ("<s>", "x\\")}, {"controls": ("<s>", "</s>", "[INST]", "[/INST]", "><")}, {"end": "x"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [
        (1, 0, "user", [part("text", "Look: <|image|> "), part("image", ref="a.png", w=57, h=28), part("text", "</"), part("text", "s> and"), part("audio", ref="b.wav", s=1.01), part("document", ref="c.pdf", p=3)]),
        (1, 1, "assistant", [part("text", "I see"), part("image", ref="d.png"), part("text", " <s>")]),
        (1, 2, "user", [part("video", ref="e.mp4"), part(None, "plain"), None]),
        (1, 3, "assistant", None),
        (1, 4, "assistant", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    pieces = chat.formatted(df)
    whole = chat.assembled(pieces).first()
    assert whole.text == (
        "<s>[INST] user [/INST] Look: <\\|image|> <|image|><\\/s> and<|audio|><|document|></s><s>[INST] assistant [/INST] I see<|image|> <\\s></s>"
        "<s>[INST] user [/INST] <|attachment|>plain</s><s>[INST] assistant [/INST] </s><s>[INST] assistant [/INST] </s>"
    )
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in whole.attachments] == [(1, "image", "a.png", 3), (1, "audio", "b.wav", 26), (1, "document", "c.pdf", 3072), (2, "image", "d.png", 1), (3, "video", "e.mp4", 0)]
    assert whole.tokens == 3 + 26 + 3072 + 1
    for a in whole.attachments:
        mark = f"<|{a.kind}|>" if a.kind != "video" else "<|attachment|>"
        assert whole.text[a.at : a.at + len(mark)] == mark
    assert "".join(chat.unescaped(whole.text[x.start : x.stop]) for x in whole.loss) == "I see <s>"
    got = chat.read_back(pieces).first()
    assert (got.n_turns, got.loss_chars, got.loss_sha256, got.formatted_chars, got.n_attachments, got.attachment_tokens) == (5, 9, sha("I see <s>"), len(whole.text), 5, whole.tokens)
