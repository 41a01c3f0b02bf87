"""The training-data operators against brute force, libraries and round trips; odd inputs."""

import hashlib
import pathlib
import random
import re
import time
import weakref
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noticemill.llm import bpe, common, decontaminate, embeddings, langid, lines, pii, secrets, sentences, simhash, suffixes

SF = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string"
LONG = "Sobre a casa e o jardim, nada mais. " * 4000


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


ODD = [None, "", " ", "\n\n", "é" * 60, "z" * 49, LONG, LONG, "a\0b", "🎉" * 30, "one two", "$1,000 \\ 'x'"]
APPLY = {
    "pii": lambda d, s: pii.personal_data(d),
    "sentences": lambda d, s: sentences.drop_repeated_spans(d),
    "secrets": lambda d, s: secrets.secret_findings(d),
    "suffixes": lambda d, s: suffixes.drop_repeats(d),
    "lines": lambda d, s: lines.dedup_lines(d),
    "embeddings": lambda d, s: embeddings.near_vectors(d.selectExpr("*", "doc_id as vec_id", "lang as label", "array(cast(length(text) as double), 1e-200, 2e200) as embedding")).withColumnRenamed("vec_id", "doc_id"),
    "langid": lambda d, s: langid.identify_languages(d),
    "decontaminate": lambda d, s: decontaminate.contamination(d, s.createDataFrame([(1, "one two"), (2, None), (3, "")], "item_id long, text string")),
    "simhash": lambda d, s: simhash.simhash_groups(d),
    "bpe": lambda d, s: bpe.bpe_round_trip(d),
}


@pytest.mark.parametrize("name", APPLY)
def test_odd_texts_repeated_rows_clashing_columns(spark, name):
    rows = [(i, t, "en" if i % 2 else None, None, None, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], None, None, None, "y")]
    df = spark.createDataFrame(rows, TEXTS + ", lang string, name string, n long, version string")
    assert sorted(r.doc_id for r in APPLY[name](df, spark).collect()) == sorted(r[0] for r in rows)


@pytest.mark.parametrize("name", APPLY)
def test_empty_table(spark, name):
    assert APPLY[name](spark.createDataFrame([], TEXTS + ", lang string"), spark).count() == 0


def test_pii_base_spans(spark, docs, texts):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - (9 if c > "4" else 0) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    odd = {
        10**6: "a@b.c_d@e.f x@y@z.w ..@a.b 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4",
        10**6 + 1: "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111111111111",
        10**6 + 2: "+1 (385) 555-1563 +1+2+3 +12345678. é🎉 aé@b.co " + "1 " * 3000,
    }
    df = docs.select("doc_id", "text").union(spark.createDataFrame(list(odd.items()), TEXTS))
    for r in pii.personal_data(df).collect():
        t = (texts | odd)[r.doc_id]
        base = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, t) if ok(m[0])]
        assert r.base_sha256 == sha(",".join(base)) and r.spans == ",".join(base)


def test_pii_further_kinds(spark):
    t = "my SSN is 123-45-6789; pay to IBAN DE89370400440532013000, call me at 415-555-2671; part no. 123-45-6789; version 415-555-2671"
    spans = pii.personal_data(spark.createDataFrame([(1, t)], TEXTS)).first().spans
    assert [t[int(a) : int(b)] for _, a, b in (x.split(":") for x in spans.split(","))] == ["123-45-6789", "DE89370400440532013000", "415-555-2671"]


#: Sentences that neither trees nor thresholds have seen, written after both.
UNSEEN = {
    "ssn": (
        "Patient record, SSN: [[523-11-4098]], blood type A.",
        "He lost his social security card ([[267 30 9144]]) on the bus.",
        "National ID [[341.62.7705]] belongs to the tenant",
        "insurance number [[188-27-6640]] expires soon",
        "Version 523-11-4098 of the firmware is broken.",
        "Item 267 30 9144 is sold out.",
        "The sum of 341.62.7705 looks odd.",
        "ref 188276640",
    ),
    "iban": (
        "Kindly remit the rent to [[NL91 ABNA 0417 1643 00]].",
        "Bank: Example, IBAN [[CH9300762011623852957]], BIC unknown",
        "cuenta [[ES79-2100-0813-6101-2345-6789]]",
        "refund to [[BE68 5390 0754 7034]] please",
        "Part CH93 0076 2011 6238 5295 8 is obsolete.",
        "The code was NL92 ABNA 0417 1643 00, page 7.",
        "MODEL AA11 2222 3333 4444",
    ),
    "tel": (
        "Contact the front desk: [[312-555-0188]].",
        "Telefon [[089 4567 1234]] (Frau Keller)",
        "Appelez le [[06 12 34 56 78]] avant midi.",
        "mobile [[(646) 555-0122]] at night",
        "It ran from 2019-03-14 to 2020-01-02.",
        "Serial 312-555-0188 was recalled.",
        "The ratio is 12.50.75.20 in the mix.",
        "Page 089 4567 1234 does not exist.",
        "We counted 300 400 500 sheep.",
    ),
    "mail": (
        "Questions? E-mail [[lee_k [at] museum [dot] org]].",
        "My contact is [[tom.b(at)garden.net]]",
        "please write [[office at mill dot co dot uk]] soon",
        "Look at example dot matrices.",
        "They met at nine.thirty on Monday",
        "She arrived at last. Then it rained.",
    ),
}


def test_pii_precision_and_recall_on_unseen_sentences(spark):
    own = pii._sentences(spark, UNSEEN).withColumn("doc_id", F.monotonically_increasing_id()).cache()
    got = {r.doc_id: {x for x in r.spans.split(",") if x.split(":")[0] in pii.MORE} for r in pii.personal_data(own).collect()}
    rows = own.collect()
    right = sum(len(got[r.doc_id] & set(r.truths)) for r in rows)
    found, true = sum(map(len, got.values())), sum(len(r.truths) for r in rows)
    assert true == 15 and right / found >= 0.9 and right / true >= 0.8, (right, found, true, [(r.text, got[r.doc_id]) for r in rows if got[r.doc_id] != set(r.truths)])


def test_pii_selection_among_overlaps(spark):
    draw = random.Random(5)
    texts = []
    for n in range(60):
        spans = {(a, a + draw.randint(8, 40), draw.randint(0, 5)) for a in (draw.randint(0, 300 if n % 2 else 30000) for _ in range(draw.randint(0, 400 if n == 1 else 60)))}
        texts.append((n, sorted((a, b, (float(s), b - a, -a, -(b % 4), -(a % 2))) for a, b, s in spans)))
    # no more than NEAR starts may lie under a span, as the generators guarantee
    texts = [(n, [x for i, x in enumerate(p) if n != 1 or i % 2]) for n, p in texts]
    kind = "doc_id long, passed array<struct<start int, end int, rank struct<score double, size int, first int, kind int, wide int>>>"
    got = {r.doc_id: [(x.start, x.end, x.kind) for x in r.stands] for r in pii._selected(spark.createDataFrame(texts, kind)).collect()}
    for n, own in texts:
        overlap = {x: [y for y in own if y != x and y[0] < x[1] and x[0] < y[1]] for x in own}
        won = {x for x in own if all(y[2] < x[2] for y in overlap[x])}
        assert got[n] == [(x[0], x[1], x[2][3]) for x in own if x in won or not any(y in won for y in overlap[x])]


def test_pii_generators_overlap_and_one_span_stands(spark):
    t = "IBAN DE89370400440532013000 and SSN 457 55 5462"
    own = pii._proposed(spark.createDataFrame([(1, t)], TEXTS), pii.GENERATORS).first()
    assert all(len(own[c]) == 1 for c in ("c_iban0", "c_iban1", "c_ssn1", "c_tel1")) and not own["c_ssn0"]
    spans = pii.personal_data(spark.createDataFrame([(1, t)], TEXTS)).first().spans
    assert spans == f"ssn:{t.index('457')}:{len(t)},iban:5:27"


def test_pii_generators_in_linear_time(spark):
    rows = [(n, x * 40_000) for n, x in enumerate(("a", "a at ", "1", "12-", "DE12 ", "a(at)", "0 12 "))]
    begun = time.monotonic()
    assert pii.personal_data(spark.createDataFrame(rows, TEXTS)).count() == len(rows)
    pii.personal_data(spark.createDataFrame(rows, TEXTS)).collect()
    assert time.monotonic() - begun < 120


def test_sentence_spans():
    for t in [LONG, "a. b! c?d e\n\n f.. g", "..", "x\n\ny"]:
        assert "".join(sentences.sentences(t)) == t


def test_sentence_spans_remove_all_but_first(spark):
    passage = "The quick brown fox jumps over one lazy dog today. Then it sleeps for seven long hours in the sun. Nobody knows why it would. "
    rows = [(2, "Start here. " + passage + "End."), (1, passage + "Other."), (3, "Unrelated text of its own stands here.")]
    out = {r.doc_id: r for r in sentences.drop_repeated_spans(spark.createDataFrame(rows, TEXTS)).collect()}
    assert out[1].n_removed == 0 and out[3].n_removed == 0 and out[2].kept == "Start here. End."


def test_sentence_spans_are_those_of_every_run(spark):
    """Against every run of two or more sentences with 20 or more words, texts in order of doc_id."""
    rnd = random.Random(6)
    pool = [" ".join(rnd.choice("abcdefgh") * 2 for _ in range(rnd.choice([1, 2, 4, 9, 22]))) + "." for _ in range(25)] + ["你好世界今天我们去公园散步。", "再见了我的朋友明天还要来。"]
    rows = []
    for d in range(30):
        parts = [rnd.choice(pool) for _ in range(rnd.randint(0, 9))]
        for _ in range(rnd.randint(0, 2)):
            t = rnd.randrange(1 + len(parts))
            src = rnd.choice(rows)[1] if rows else []
            parts[t:t] = src[: rnd.randint(0, 6)]
        rows.append((d, parts))
    size = lambda s: len(s.split()) + sum("\u4e00" <= c <= "\u9fff" for c in s) // 2
    seen, want = set(), {}
    for d, parts in rows:
        gone = set()
        for i in range(len(parts)):
            for e in range(i + 2, len(parts) + 1):
                if sum(map(size, parts[i:e])) >= 20:
                    if (run := tuple(parts[i:e])) in seen:
                        gone |= set(range(i, e))
                    seen.add(run)
        want[d] = " ".join(p for n, p in enumerate(parts) if n not in gone)
    found = {r.doc_id: " ".join(r.kept.split()) for r in sentences.drop_repeated_spans(spark.createDataFrame([(d, " ".join(p)) for d, p in rows], TEXTS)).collect()}
    assert found == want


def test_secrets_ledger_is_incremental(spark, docs, texts, tmp_path, monkeypatch):
    at = str(tmp_path / "ledger")
    rows = lambda: secrets.read_ledger(spark, at).collect()
    some = secrets.secret_findings(docs.where("doc_id < 100"), at).count()
    first = rows()
    assert some == sum(d < 100 for d in texts) and {r.blob for r in first} == {sha(texts[d]) for d in texts if d < 100}
    whole = {r.doc_id: tuple(r) for r in secrets.secret_findings(docs, at).collect()}
    assert {r.blob for r in rows()} == {sha(t) for t in texts.values()}
    size = spark.read.parquet(at).count()
    assert whole == {r.doc_id: tuple(r) for r in secrets.secret_findings(docs, at).collect()} and spark.read.parquet(at).count() == size
    assert whole == {r.doc_id: tuple(r) for r in secrets.secret_findings(docs).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for d, t in texts.items():
        found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert whole[d][4] == sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found)))


def test_secrets_of_all_versions_of_a_path(spark, tmp_path, monkeypatch):
    at, form = str(tmp_path / "ledger"), "path string, version long, text string"
    old = [("a", 1, "token = abcdefghijkl"), ("a", 2, "nothing"), ("b", 1, "token = abcdefghijkl"), (None, None, None)]
    found = lambda rows: sorted((str(r.path), r.version, r.n_assign) for r in secrets.secret_findings(spark.createDataFrame(rows, form), at, ["path", "version"]).collect())
    assert found(old) == [("None", None, 0), ("a", 1, 1), ("a", 2, 0), ("b", 1, 1)]
    assert spark.read.parquet(at).count() == 3
    new = [*old, ("a", 3, "AKIA" + "Q" * 16), ("c", 1, "nothing")]
    assert ("a", 3, 0) in found(new) and spark.read.parquet(at).count() == 4
    monkeypatch.setattr(secrets, "RULE_VERSION", "next")
    assert len(found(new)) == 6 and spark.read.parquet(at).count() == 8


def test_secrets_in_linear_time():
    import time

    began = time.perf_counter()
    for t in ["-eyJaaaa" * 60_000, "ghp_" + "a" * 500_000 + "_", "password" + " " * 500_000, "eyJaaaaaaaa." * 50_000]:
        secrets.find_secrets(t)
    assert time.perf_counter() - began < 5


def brute_repeats(rows):
    least, out = {}, {}
    for d, t in rows:
        x = t.encode()
        for i in range(len(x) - 49):
            w = x[i : i + 50]
            least[w] = min(d, least.get(w, d))
    for d, t in rows:
        x, gone = t.encode(), bytearray(len(t.encode()))
        for i in range(len(x) - 49):
            if least[x[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(x), sum(gone), spans, sha(bytes(b for b, g in zip(x, gone) if not g)))
    return out


def test_suffix_repeats(spark, docs, texts):
    odd = {3001: "a" * 200, 3002: "a" * 60, 3003: "xy" + "ab" * 60, 3004: "ab" * 100, 3005: "é" * 40, 3006: "é" * 40, 3007: "z" * 50 + "\0" * 60, 3008: "\0" * 70 + "q"}
    df = docs.select("doc_id", "text").union(spark.createDataFrame(list(odd.items()), TEXTS))
    assert {r.doc_id: tuple(r[1:]) for r in suffixes.drop_repeats(df).collect()} == brute_repeats([*(texts | odd).items()])


def test_interval_tree_finds_maximal_repeats():
    rnd = random.Random(5)
    for _ in range(30):
        data = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(40)), np.uint8)
        starts, raw = np.arange(len(data)), data.tobytes()
        lefts = np.concatenate(([-1], data[:-1].astype(np.int64)))
        order, lcp, tree, diverse = suffixes.maximal_repeats(data, starts, len(data) - starts, lefts, 2)
        rows = list(zip(tree.length.tolist(), tree.first.tolist(), tree.end.tolist()))
        found = {(n, tuple(sorted(order[a:b].tolist()))) for (n, a, b), x in zip(rows, diverse) if x}
        for k, up in enumerate(tree.parent.tolist()):
            above = [r for r in rows if r[1] <= rows[k][1] and r[2] >= rows[k][2] and r[0] < rows[k][0]]
            assert (max(above) if above else None) == (rows[up] if up >= 0 else None)
        for p, k in enumerate(tree.deepest(lcp).tolist()):
            assert max((n for n, a, b in rows if a <= p < b), default=None) == (rows[k][0] if k >= 0 else None)
        want = set()
        for n in range(2, len(raw)):
            for w in {raw[i : i + n] for i in range(len(raw) - n + 1)}:
                at = [i for i in range(len(raw) - n + 1) if raw.startswith(w, i)]
                right = {raw[i + n : i + n + 1] for i in at}
                if len(at) > 1 and (len(right) > 1 or b"" in right) and (len({raw[i - 1] for i in at if i}) > 1 or 0 in at):
                    want.add((n, tuple(at)))
        assert found == want


def test_repeat_groups_are_whole(spark):
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    long, part, own = text(2000), text(120), text(300)
    rows = [(1, text(200) + long + text(90)), (2, text(70) + long + text(60) + part), (3, long[500:1900] + text(40) + part + text(9)), (4, own + text(30) + own), (5, "a" * 60)]
    raw = {d: t.encode() for d, t in rows}
    at = sorted(((d, i) for d, x in raw.items() for i in range(len(x))), key=lambda p: raw[p[0]][p[1] :])
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    lcp = [0] + [common(raw[a][i:], raw[b][j:]) for (a, i), (b, j) in zip(at, at[1:])] + [0]
    want = set()
    for k, n in enumerate(lcp):
        if n >= 50:
            first, end = k - 1, k + 1
            while lcp[first] >= n:
                first -= 1
            while lcp[end] >= n:
                end += 1
            if any(i == 0 for _, i in at[first:end]) or len({raw[d][i - 1] for d, i in at[first:end]}) > 1:
                want.add((n, tuple(sorted(at[first:end]))))
    found = {}
    for r in suffixes.repeat_groups(spark.createDataFrame(rows, TEXTS)).collect():
        found.setdefault((r.repeat, r.length), []).append((r.doc_id, r.start))
    assert max(n for n, _ in want) == 2000 and sorted((n, tuple(sorted(x))) for (_, n), x in found.items()) == sorted(want)


def test_line_runs_keep_the_first(spark):
    run = "a line that is surely long enough to count\nand its successor, of some length too"
    rows = [(1, f"x\n{run}\ny"), (2, f"{run}\nz"), (3, "a line that is surely long enough to count\nelse"), (4, "\n\n\n")]
    out = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.kept_sha256) for r in lines.dedup_lines(spark.createDataFrame(rows, TEXTS)).collect()}
    assert out == {1: (4, 0, 0, sha(rows[0][1])), 2: (3, 2, 1, sha("z")), 3: (2, 0, 0, sha(rows[2][1])), 4: (4, 0, 0, sha(rows[3][1]))}


def brute_lines(rows):
    """Lines that are left: every later copy of every run that counts is taken out."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        parts = t.split("\n")
        total = [0]
        for p in parts:
            total.append(total[-1] + len(p))
        gone = set()
        for i in range(len(parts)):
            for e in range(i + 1, len(parts) + 1):
                chars = total[e] - total[i]
                if (e - i >= 2 and chars >= 30) or chars >= 80:
                    if (run := tuple(parts[i:e])) in seen:
                        gone |= set(range(i, e))
                    seen.add(run)
        out[d] = "\n".join(p for n, p in enumerate(parts) if n not in gone)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_line_runs_of_any_length(spark, seed):
    rnd = random.Random(seed)
    line = lambda: rnd.choice(["", "", "ab", "a" * 9, "b" * 14, "c" * 31, "d" * 80, "e" * 12, f"own {rnd.random()}"])
    runs = [[line() for _ in range(n)] for n in (3, 4, 7, 12, 21, 50)]
    rows = []
    for d in range(14):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            run = rnd.choice(runs)
            a = rnd.choice([0, 0, rnd.randrange(len(run))])
            parts += [*(line() for _ in range(rnd.randint(0, 3))), *run[a : rnd.choice([len(run), rnd.randint(a, len(run))])]]
        rows.append((d, "\n".join(parts)))
    rows += [(20, "\n" * 40), (21, "x" * 20 + "\n" * 70), (22, "\n".join(["ab"] * 33)), (23, "\n".join(["ab", "cd"] * 19)), (24, "\n".join(["ab"] * 9))]
    out = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, TEXTS)).collect()}
    want = brute_lines(rows)
    for d, t in rows:
        assert (out[d].kept_sha256, out[d].n_lines) == (sha(want[d]), t.count("\n") + 1), d


def test_long_line_alone_is_a_run(spark):
    long = "one paragraph that stands on a single line and is copied between other neighbours, word by word " * 2
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, long), (4, "short line\ne"), (5, "short line\nf")]
    left = {r.doc_id: r.text for r in lines.without_repeated_lines(spark.createDataFrame(rows, TEXTS)).collect()}
    assert left == {1: rows[0][1], 2: "c\nd", 4: rows[3][1], 5: rows[4][1]}


def test_run_of_short_lines_counts_as_a_whole(spark):
    verse = "\n".join(f"verse {c}" for c in "abcdefg")
    mixed = "short\n\ntiny\nthe one line of this run that is long enough\nx\ny"
    rows = [(1, f"one\n{verse}\ntwo"), (2, f"three\n{verse}\nfour"), (3, f"five\n{mixed}\nsix"), (4, f"{mixed}\nseven"), (5, "a\nb\nc"), (6, "a\nb\nd\n\n\n\n\ne"), (7, "f\n\n\n\n\ng")]
    left = {r.doc_id: r.text for r in lines.without_repeated_lines(spark.createDataFrame(rows, TEXTS)).collect()}
    assert left == dict(rows) | {2: "three\nfour", 4: "seven"}


def test_line_dedup_round_runs_few_stages(spark):
    def stages(n):
        run = "\n".join(f"line {i} of the run" for i in range(n))
        spark.sparkContext.setJobGroup(f"lines {n}", "")
        left = {r.doc_id: r.text for r in lines.without_repeated_lines(spark.createDataFrame([(1, run), (2, f"{run}\nend"), (3, f"x\n{run}")], TEXTS)).collect()}
        assert left == {1: run, 2: "end", 3: "x"}
        tracker = spark.sparkContext.statusTracker()
        return len({s for j in tracker.getJobIdsForGroup(f"lines {n}") for s in tracker.getJobInfo(j).stageIds})

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so that plans don't depend on sizes
    try:
        assert stages(8) - stages(4) <= 50  # one round more
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def brute_links(vectors):
    n, own = len(vectors), [(i, k, np.asarray(v, float)) for i, k, v in vectors if k is not None and v and np.isfinite(v).all() and np.any(v)]
    root, count = {i: i for i, _, _ in vectors}, {i: 0 for i, _, _ in vectors}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(own)):
        for b in range(a + 1, len(own)):
            (i, k, x), (j, m, y) = own[a], own[b]
            if k == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                count[i] += 1
                count[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    assert n == len(root)
    return {i: (count[i], find(i), find(i) == i) for i in root}


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows, centres = [], rng.standard_normal((12, 64))
    for i in range(240):
        v = centres[i % 12] + rng.standard_normal(64) * rng.choice([0, 0.02, 0.1, 0.15])
        rows.append((i, int(i % 3), [float(x) for x in v]))
    rows += [(900, 1, None), (901, 1, []), (902, 1, [0.0] * 64), (903, None, rows[0][2]), (904, 1, [float("nan")] * 64), (905, 0, [2 * x for x in rows[0][2]]), (906, 0, [1.0, 2.0]), (907, 0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert {r.vec_id: tuple(r[1:]) for r in embeddings.near_vectors(df).collect()} == brute_links(rows)


def test_embeddings_of_any_scale(spark):
    tiny, huge = 1e-200, 1e200
    rows = [(1, 0, [tiny, tiny]), (2, 0, [tiny, tiny * 1.01]), (3, 0, [huge, huge]), (4, 0, [huge, 0.0]), (5, 0, [huge, -huge * 0.1]), (6, 0, [5e-324, 0.0]), (7, 0, [1.7e308, 1.7e308])]
    out = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert out == {1: (3, 1), 2: (3, 1), 3: (3, 1), 7: (3, 1), 4: (2, 4), 5: (2, 4), 6: (2, 4)}


def test_embeddings_meet_fewer_than_all(spark):
    """Meetings in cells of unrelated vectors, at one and four times as many: fewer than all pairs, growing more slowly."""
    rng, met = np.random.default_rng(9), []
    for n in (500, 2000):
        rows = [(i, 0, v) for i, v in enumerate(rng.standard_normal((n, 32)).tolist())]
        classes = spark.createDataFrame(rows, "id long, label int, s array<double>")
        met.append(embeddings.meetings(embeddings.place(classes, even=100)).count())
    assert met[0] < 500 * 499 / 2 and met[1] < 2000 * 1999 / 4 and met[1] < 11 * met[0]


def test_language_id_held_out(docs):
    out = langid.identify_languages(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in out if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.85 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_id_backs_off():
    model = langid.build([(0, "casa", "pt", 5), (0, "house", "en", 5), (2, "ça", "pt", 3), (2, "th", "en", 3), (1, "t", "en", 2), (1, "ã", "pt", 2)])
    assert model.predict("Casa")[0] == "pt" and model.predict("the")[0] == "en" and model.predict("ã")[0] == "pt"
    assert model.predict("123 !")[0] == "und" and model.predict(None) == ("und", 0.0)


def test_language_id_scores_as_defined(spark, docs, texts):
    """The score of each text by the formula: add-one smoothed log frequencies of words, else the mean over known n-grams."""
    counts = {}
    for r in docs.collect():
        if r.lang and r.doc_id % 5:
            for w in re.findall(r"[^\W\d_]+", r.text.lower()):
                for n in range(5):
                    padded = w if n < 2 else f"<{w}>"
                    for t in [w] if n == 0 else [padded[i : i + n] for i in range(len(padded) - n + 1)]:
                        counts[n, t, r.lang] = counts.get((n, t, r.lang), 0) + 1
    model = langid.build([(n, t, lang, c) for (n, t, lang), c in counts.items()])
    langs = sorted({k[2] for k in counts})
    known = {k[:2] for k in counts}
    kinds = {n: sum(k[0] == n for k in known) for n in range(5)}
    sums = {(n, x): sum(c for k, c in counts.items() if k[0] == n and k[2] == x) for n in range(5) for x in langs}
    logp = lambda n, t, x: np.log((counts.get((n, t, x), 0) + 1) / (sums[n, x] + kinds[n]))
    for d in sorted(texts)[:60]:
        total = {x: 0.0 for x in langs}
        for w in re.findall(r"[^\W\d_]+", texts[d].lower()[:3000]):
            for n in (0, 4, 3, 2, 1):
                padded = w if n < 2 else f"<{w}>"
                own = [t for t in ([w] if n == 0 else [padded[i : i + n] for i in range(len(padded) - n + 1)]) if (n, t) in known]
                if own:
                    for x in langs:
                        total[x] += sum(logp(n, t, x) for t in own) / len(own)
                    break
        found = model.total(texts[d][:3000])
        assert found is None or np.allclose(found[0], [total[x] for x in langs]) and found[1] == len(langid.words_of(texts[d][:3000]))


def test_language_id_score_is_calibrated(spark, docs):
    model = langid.train(docs)
    assert model.agreement in langid.AGREEMENTS and model.agreement > 0
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in langid.identify_languages(docs, model).collect() if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert abs(sum(r.score for r in held) / len(held) - sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held)) < 0.1


def test_language_id_keeps_short_texts(spark, docs):
    short = docs.where("lang is not null and text rlike '[a-z]{3}'").withColumn("text", F.substring_index("text", " ", 8))
    kept = langid.keep_identified(short, model=langid.train(docs))
    assert kept.columns == short.columns and kept.count() >= 0.95 * short.count() > 50


def test_language_id_learns_small_and_many_languages(spark):
    letters = "abcdefghijklmnopqrst"
    word = lambda k: "".join(letters[k // 20**j % 20] for j in range(4))
    ids = iter(i for i in range(20_000) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(next(ids), " ".join([word(k), word(k + 2000)]), f"l{k:04}") for k in range(1100) for _ in range(1 if k == 1099 else 2)]
    model = langid.train(spark.createDataFrame(rows, TEXTS + ", lang string"))
    assert len(model.languages) == 1100 and model.dense is None
    assert model.predict(f"{word(1099)} {word(3099)}")[0] == "l1099"


def test_language_id_is_the_same_in_both_layouts():
    model = langid.build([(0, "casa", "pt", 5), (0, "casa", "es", 2), (2, "ça", "pt", 3), (2, "th", "en", 3), (1, "t", "en", 2), (1, "ã", "pt", 2)])
    sparse = langid.Model(*model.parts())
    sparse.dense = None
    assert model.dense is not None and all(np.allclose(model.word(w), sparse.word(w)) for w in ["casa", "thça", "tã", "x"])


def test_language_id_remembers_only_words_that_were_not_learned(monkeypatch):
    """Learned words are looked up where they are laid out, in no cache; neither its size nor the layout changes a sum."""
    counts = [(0, "casa", "pt", 5), (0, "house", "en", 5), (2, "ça", "pt", 3), (2, "th", "en", 3), (1, "t", "en", 2), (1, "ã", "pt", 2)]
    text = "Casa thça house tã x casa thça " + " ".join(f"th{a}{b} casa" for a in "abc" for b in "xyz")
    model, small, sparse = (langid.build(counts) for _ in range(3))
    model.predict("casa house casa")
    assert not model.known
    expected = sum(model.word(w) for w in langid.words_of(text))
    assert np.allclose(model.total(text)[0], expected) and set(model.known) == set(langid.words_of(text)) - {"casa", "house"}
    small.room, sparse.dense = 3, None
    monkeypatch.setattr(langid, "AT_ONCE", 4)
    for other in (small, sparse):
        assert np.allclose(other.total(text)[0], expected) and len(other.known) <= other.room


def test_language_id_keeps_all_words_of_the_sample(spark):
    ids = iter(i for i in range(20_000) if zlib.crc32(str(i).encode()) % 3 != 1)
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    rows = [(next(ids), " ".join(f"{name(k)}x " * 2 for k in range(b, b + 1000)), "big") for b in range(0, 61_000, 1000)] + [(next(ids), "rareword", "small")]
    model = langid.train(spark.createDataFrame(rows, TEXTS + ", lang string"))
    assert (0, "rareword") in model.rows and sum(n == 0 for n, _ in model.rows) == 61_001


def test_decontamination_both_joins_and_short_items(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, f"so {item.upper()} end"), (2, "beta gamma delta epsilon zeta eta theta iota kappa. Lambda; no"), (3, "alpha beta gamma delta epsilon zeta eta theta iota kap"), (4, "say: Short-Item here"), (5, None)]
    items = spark.createDataFrame([(1, item), (2, "short item"), (3, "!")], "item_id long, text string")
    for bound in (1 << 20, 0):
        out = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(spark.createDataFrame(rows, TEXTS), items, bound).collect()}
        assert out == {1: (12, 1, True), 2: (10, 1, True), 3: (0, 0, False), 4: (2, 1, True), 5: (0, 0, False)}


def brute_fingerprint(t):
    words = [w for w in re.split("[ \t-\r]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints(docs, texts):
    for r in simhash.simhash_groups(docs).collect():
        assert int(r.fingerprint, 16) == brute_fingerprint(texts[r.doc_id])


@pytest.mark.parametrize("dense", [1, 32])
def test_simhash_links(spark, dense):
    rnd = random.Random(dense)
    marks = {rnd.getrandbits(64) for _ in range(20)}
    for m in list(marks):
        for _ in range(rnd.randint(0, 12)):
            marks.add(m ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3))))
    marks = sorted(marks)
    rows = [(i, m - (1 << 64) if m >> 63 else m) for i, m in enumerate(marks)]
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 2:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "id long, fp long"), dense)
    found = {r.id: r.component for r in common.components(links).collect()}
    assert {i: found.get(i, i) for i in range(len(marks))} == {i: find(i) for i in range(len(marks))}


def test_near_copies_without_and_with_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i * i % 97}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (1, c), (1, c), (2, c), (1, d), (None, c), (3, d)]
    left = [tuple(r) for r in simhash.drop_near_copies(spark.createDataFrame(rows, TEXTS)).collect()]
    assert sorted(left, key=str) == sorted([(None, a), (None, b), (1, c), (1, d)], key=str)


def test_components_of_chains_and_stars(spark, monkeypatch):
    stored, keep = [], common.Scratch.keep
    monkeypatch.setattr(common.Scratch, "keep", lambda self, df: stored.append(1) or keep(self, df))
    edges = [(i, i + 1) for i in range(100, 10_100)] + [(50_000, i) for i in range(20_000, 20_060)] + [(7, 7)]
    found = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len(found) == 10_001 + 61 and all(found[i] == 100 for i in range(100, 10_101)) and all(found[i] == 20_000 for i in [50_000, *range(20_000, 20_060)])
    assert len(stored) <= 2 + 3 * 20  # three tables a round


def test_components_of_random_graphs(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)]
    root = list(range(400))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in edges:
        p, q = sorted((find(u), find(v)))
        root[q] = p
    found = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: find(i) for e in edges if e[0] != e[1] for i in e}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bpe_equals_the_library(texts):
    path = public_tokenizers.path(bpe.VOCABULARY)
    own, library, rnd = bpe.load(path), Tokenizer.from_file(path), random.Random(2)
    odd = ["", " ", "\n\t  x", "it's 'll'", "<|endoftext|>a<|endoftext|>", "日本語🎉é́", "a\x1c\x85 b", "aaaaaaaa" * 30]
    odd += ["".join(rnd.choice("abcdef é'12\n ") for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    for t in [*texts.values(), *odd]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_pipeline(spark, docs):
    import corpus_pipeline

    got = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert got and got <= {r.doc_id for r in docs.collect()}
    left, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "decontaminate", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = common.Scratch(spark).keep(stage(spark, left, SF))
        assert left.columns == docs.columns and left.count() > 0
    groups = simhash.simhash_groups(left).collect()
    assert all(r.component_id == r.doc_id for r in groups)
    assert not any(r.contaminated for r in decontaminate.contamination(left, spark.read.parquet(f"{SF}/benchmark.parquet")).collect())
    assert got == {r.doc_id for r in left.collect()}


def test_stages_keep_columns_of_any_name(spark, docs):
    import corpus_pipeline

    names = ["_gone", "_left", "_d", "_v", "_kept", "row", "version", "n"]
    left = docs.withColumns({n: docs["source"] for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = common.Scratch(spark).keep(stage(spark, left, SF))
        assert left.columns == [*docs.columns, *names] and left.where(" or ".join(f"{n} <> source" for n in names)).isEmpty()


def test_stages_of_odd_and_empty_tables(spark):
    import corpus_pipeline

    form = TEXTS + ", lang string, source string, n_chars long"
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(ODD)] + [(3, ODD[3], None, "x", 1), (None, "alone", None, None, 5), (None, None, None, None, None)]
    odd, empty = spark.createDataFrame(rows, form), spark.createDataFrame([], form)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        left = stage(spark, odd, SF).collect()
        # line_dedup: the second long text is a later copy as a whole
        sizes = {"line_dedup": len(rows) - 1, "decontaminate": len(rows), "bpe": len(rows)}
        assert len(left) == sizes.get(name, len(left)), name
        if name == "simhash_near_dedup":  # null, empty and blank texts are one group
            assert sum(not (r.text or "").strip() for r in left) == 1


def test_queries_equal_their_sql(spark):
    import duckdb

    from noticemill.llm.queries import ORACLE_SQL, QUERIES

    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        got = QUERIES[name](spark, SF)
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())


def brute_groups(texts):
    marks = {d: brute_fingerprint(t) for d, t in texts.items()}
    ids, root = sorted(marks), {d: d for d in marks}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (marks[i] ^ marks[j]).bit_count() <= 2:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {d: find(d) for d in ids}


def test_simhash_components(docs, texts):
    assert {r.doc_id: r.component_id for r in simhash.simhash_groups(docs).collect()} == brute_groups(texts)


def test_suffix_blocks_are_bounded_with_a_phrase_in_all_documents(spark):
    """A phrase shorter than a window in every text, between different words: what a string of up to so many documents brings bounds a block."""
    rnd, phrase = random.Random(8), "all rights reserved by the invented firm"
    word = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    for n in (1000, 8000):
        rows = [(i, f"{word(200)}{phrase}{word(200)}") for i in range(n)] + [(n + i, f"{'shared by some texts only, and long enough to go ' * 2}{word(60)}") for i in range(20)]
        runs, _ = suffixes._runs_of_shared(suffixes._texts(spark.createDataFrame(rows, TEXTS)), settle=True)
        most = runs.where("part >= 0").groupBy("part").agg(F.sum(F.length("content")).alias("n")).agg(F.max("n")).first()[0]
        assert most < 62 * suffixes.SAMPLE_DOCS / suffixes.SAMPLE_SHARE, (n, most)  # 61,748 bytes for 1,000 documents, were it not set apart
    out = {r.doc_id: r for r in suffixes.drop_repeats(spark.createDataFrame(rows, TEXTS)).collect()}
    assert not any(out[i].n_removed for i in range(n)) and all(out[n + i].n_removed >= 50 for i in range(1, 20))


def test_suffix_repeats_whatever_counts_as_frequent(spark, monkeypatch):
    rnd = random.Random(9)
    parts = ["".join(rnd.choices("ab", k=rnd.choice([30, 50, 70, 200]))) for _ in range(6)]
    rows = [(i, "".join(rnd.choices(parts, k=rnd.randint(0, 6)))) for i in range(60)]
    want = brute_repeats(rows)
    marks = np.random.default_rng(1).random(suffixes._MARKS) < 0.5
    for table in (np.zeros(suffixes._MARKS, bool), np.ones(suffixes._MARKS, bool), marks):
        monkeypatch.setattr(suffixes, "frequent_marks", lambda own, total: table)  # noqa: B023
        got = suffixes.drop_repeats(spark.createDataFrame(rows, TEXTS)).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_language_model_is_handed_on_without_python_tokens(spark, docs):
    model = langid.train(docs)
    assert not {"rows", "dense", "cache"} & set(vars(model))
    assert not any(isinstance(x, dict) for x in model.parts())
    assert model.predict("123") == ("und", 0.0) and model.rows and set(vars(model)) >= {"rows"}


def test_driver_holds_one_language_model_at_a_time(spark, docs, monkeypatch):
    made, built = [], langid._built

    def watched(counts):
        assert not any(m() for m in made)
        out = built(counts)
        made.append(weakref.ref(out))
        return out

    monkeypatch.setattr(langid, "_built", watched)
    langid.keep_identified(docs)
    assert len(made) == 2 and not any(m() for m in made)


def test_stored_tables_have_no_marker_files(spark):
    scratch = common.Scratch(spark)
    assert scratch.keep(spark.range(3)).count() == 3
    names = [p.name for p in pathlib.Path(scratch.folder.removeprefix("file:")).rglob("*")]
    assert any(n.endswith(".parquet") for n in names) and not any("_SUCCESS" in n for n in names)


def test_decontamination_stores_what_has_met_only(spark, monkeypatch):
    stored, keep = [], common.Scratch.keep
    monkeypatch.setattr(common.Scratch, "keep", lambda self, df: stored.append(df.columns) or keep(self, df))
    ten, twice = " ".join(f"w{i}" for i in range(10)), " ".join(["a"] * 14)
    items = spark.createDataFrame([("x", f"{ten} more"), ("y", twice)], "item_id string, text string")
    rows = [(1, f"so {ten} it goes"), (2, twice), (2, twice), (3, "none")]
    out = sorted((r.doc_id, r.n_hit, r.n_items) for r in decontaminate.contamination(spark.createDataFrame(rows, TEXTS), items).collect())
    assert out == [(1, 10, 1), (2, 14, 1), (2, 14, 1), (3, 0, 0)]
    assert [sorted(x) for x in stored] == [["gram", "item_id", "theirs"], ["at", "doc_id", "item_id", "ours", "theirs", "version"]]
