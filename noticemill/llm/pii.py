"""Personal data by candidate gradient boosting, in DataFrame operations only.

Generators propose spans of a kind wherever its format might stand. Those of the base kinds that pass their test are
always kept. Each further kind has a narrow and a wide generator, so proposals overlap, within a kind and between kinds.
They are described by format and context features and scored by boosted trees, which are evaluated as nested conditions
in the plan. A proposal passes at or above its kind's threshold; of those that overlap the one with the best score stands.
The trees are learned on the driver from the proposals in a bounded table of made-up texts (EXAMPLES rows, built by
expressions). The thresholds are the lowest that give the wanted precision on the written sentences of SENTENCES.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

EXAMPLES = 4000
ROUNDS = 40
RATE = 0.3
PRECISION = 0.95
CONTEXT = 40
#: Proposals of further kinds are bounded in length, so those that overlap stand so near in the order of their starts.
NEAR = 200
_BLOCK = 128
#: The base kinds in order, each with a cheap test of the text and its format. Written so that no start
#: is tried within a run that failed and no group recurses: possessive, and not after a character that the run holds.
BASE = {
    "email": (r"@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){15}", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Generators of further kinds, the narrow one first: cheap test and format.
MORE = {
    "ssn": (
        (r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
        (r"[0-9]{3}[\x20.-]?[0-9]{2}[\x20.-]?[0-9]{4}", r"(?<![0-9A-Za-z.-])[0-9]{3}[\x20.-]?[0-9]{2}[\x20.-]?[0-9]{4}(?![0-9A-Za-z-])"),
    ),
    "iban": (
        (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[0-9]{4}){2,7}+(?:\x20?[0-9]{1,3})?+(?![A-Za-z0-9])"),
        (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20.-]?[A-Z0-9]{4}){2,7}+(?:[\x20.-]?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"),
    ),
    "tel": (
        (r"[0-9]{3}[\x20.-][0-9]{4}", r"(?<![0-9+(.-])(?<!\+[0-9]{1,3}[\x20.-]{0,2})\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
        (r"[0-9]\)?[\x20./-][0-9]{2}", r"(?<![0-9A-Za-z+(.,/-])(?<!\+[0-9]{1,3}[\x20.-]{0,2})\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,4}){2,4}+(?![0-9A-Za-z-])"),
    ),
    "mail": (
        (r"(?i)[\[(]\x20?at\x20?[\])]", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]{1,63}+(?:\x20?(?:[\[(]\x20?dot\x20?[\])]|\.)\x20?[a-z]{2,24}+){1,3}+"),
        (r"(?i)\x20at\x20", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20at\x20[a-z0-9-]{1,63}+(?:(?:\x20dot\x20|\.)[a-z0-9-]{2,24}+){1,3}+(?![a-z0-9-])"),
    ),
}
GENERATORS = {f"{kind}{n}": g for kind, own in MORE.items() for n, g in enumerate(own)}
#: Words before a span that speak for its kind, and words that speak for another number.
SPEAKING = {
    "ssn": r"\bssn|social security|national id|insurance n|tax id",
    "iban": r"\biban|account|konto|compte|cuenta|\bbank",
    "tel": r"\btel|phone|\bfon\b|\bcall|mobil|\bfax|contact|reach|appel|llam",
    "mail": r"mail|contact|write|reach|send|address",
}
OTHERWISE = r"\bpart|order|version|\bref|\blot\b|invoice|serial|ticket|model|\bpage|\bdate|between|score|\bsku|item"
#: Written sentences for the thresholds; what stands in double brackets is personal data of the kind.
SENTENCES = {
    "ssn": (
        "Her social security card reads [[219-09-9999]] and was issued in May.",
        "SSN [[457 55 5462]], date of birth unknown.",
        "Employee file: J. Doe, ssn=[[301-44-7788]]; salary on request.",
        "The applicant gave [[078.05.1120]] as social security number? No: as national ID: [[512-33-9081]].",
        "tax id [[612-48-1934]] was entered twice",
        "Replace serial 123-45-6789 of the pump before June.",
        "Lot 404-22-1187 of the resin failed the test.",
        "SSN 000-12-3456 is a placeholder.",
        "The invoice 219099999 is due.",
        "See part 457-55-5462 in the catalogue.",
        "Order 301 44 7788 has shipped.",
        "The score was 118-97-1042 after three rounds.",
    ),
    "iban": (
        "Please transfer to [[DE89 3704 0044 0532 0130 00]] by Friday.",
        "IBAN: [[GB29NWBK60161331926819]]",
        "Compte [[FR14 2004 1010 0505 0001 3M02 606]] chez la banque.",
        "my bank account is [[ES91 2100 0418 4502 0005 1332]]",
        "Konto [[AT61-1904-3002-3457-3201]] bitte",
        "Model AB12 3456 7890 1234 is out of stock.",
        "Serial DE12 3704 0044 0532 0130 00 of the meter",
        "Order XK77 1111 2222 3333 4444 was cancelled.",
        "The part FR99ABCD1234EFGH5678 fits both pumps.",
        "Ticket NO12 0000 1111 2222 3333 remains open.",
    ),
    "tel": (
        "Call me back on [[555-867-5309]] after six.",
        "Tel. [[030 1234 5678]], ask for Mr. Brandt.",
        "Phone: [[(212) 555-0147]]",
        "My mobile is [[0171 555 12 34]].",
        "fax [[415.555.2671]] or letter",
        "You can reach us at [[01 42 68 53 00]] on weekdays.",
        "The meeting on 2024-11-05 was moved.",
        "Version 10.20.30.40 fixes the leak.",
        "Order 100-200-3000 contains three items.",
        "Ref 4711-22-33 applies.",
        "Between 1200 1300 1400 volts the lamp fails.",
        "Invoice 555-867-5309 was paid.",
        "From 12-10-2023 on the office is closed.",
        "part no. 030 1234 5678",
    ),
    "mail": (
        "Write to [[ann.lee (at) example (dot) org]] for a copy.",
        "My address is [[joe [at] host.net]], I answer daily.",
        "contact [[kim at example dot com]] please",
        "reach [[m.rossi(at)posta.it]] for details",
        "You may send it to [[sales at shop-24 dot example dot com]] today.",
        "We met at noon. Later we left.",
        "He stayed at home.then he called",
        "She looked at dot com stocks for a while.",
        "The train stops at berlin.tegel at eight",
        "Look at readme.txt for the licence.",
    ),
}
FEATURES = ("kind", "wide", "digits", "size", "marks", "context", "otherwise", "checks")
Tree = tuple  # (feature, threshold, below, above), or a float at a leaf


def _split(text: Column, test: str, pattern: str) -> tuple[Column, Column]:
    """Matches, and the pieces of text between them."""
    there = text.rlike(test)
    none = F.array().cast("array<string>")
    return F.when(there, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none), F.when(there, F.split(text, pattern, -1)).otherwise(none)


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    value = lambda i: F.try_to_number(F.substr(turned, i, F.lit(1)), F.lit("9")).cast("int")
    twice = lambda i: F.when(i % 2 == 0, value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + twice(i)) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _passes(kind: str, m: Column) -> Column:
    """The test of a base kind."""
    if kind == "ip":
        part = lambda p: F.length(p) <= 3
        own = F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(own, lambda p: part(p) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(16, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _checks(kind: str, m: Column) -> Column:
    """Whether a further kind's own check holds: a number that can be given out, or its check digits."""
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "tel":
        dated = m.rlike(r"^(?:(?:19|20)[0-9]{2}[./-][01][0-9][./-][0-3][0-9]|[0-3][0-9][./-][01][0-9][./-](?:19|20)?[0-9]{2})$")
        return F.length(_digits(m)).between(7, 12) & ~dated & m.rlike(r"^\(?(?:0[0-9)]|[2-9][0-9]{2}[^0-9]{1,2}[2-9])")
    if kind == "mail":
        return m.rlike("(?i)(?:com|org|net|edu|gov|info|[a-z]{2})$") & (m.rlike(r"[\[(]") | m.rlike(r"(?i)\x20dot\x20"))
    packed = F.regexp_replace(m, "[^A-Z0-9]", "")
    moved = F.concat(F.substr(packed, F.lit(5)), F.left(packed, F.lit(4)))
    code = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(F.ascii(c) >= 65, 100).otherwise(10) + code(c)) % 97))
    return rest == 1


def _features(name: str, m: Column, before: Column) -> list[Column]:
    """The features of a generator's proposal, in the order of FEATURES."""
    kind, near = name[:-1], F.lower(before)
    marks = F.length(F.regexp_replace(m, "[A-Za-z0-9]", ""))
    flags = near.rlike(SPEAKING[kind]), near.rlike(OTHERWISE), _checks(kind, m)
    return [F.lit(list(MORE).index(kind)), F.lit(int(name[-1])), F.length(_digits(m)), F.length(m), marks, *(f.cast("int") for f in flags)]


def _proposed(texts: DataFrame, kinds: dict) -> DataFrame:
    """Adds c_<kind>, the proposals as (start, end, m, before), offsets in code points."""
    for k, (test, pattern, *_) in kinds.items():
        found, pieces = _split(F.col("text"), test, pattern)
        texts = texts.withColumn(f"f_{k}", found).withColumn(f"p_{k}", pieces)
    # sums over blocks, then within a block: start offsets in little more than linear time
    def total(a):
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def step(k):
        return F.transform(f"f_{k}", lambda m, i: F.length(m) + F.length(F.get(f"p_{k}", i)))

    def block(k):
        last = F.floor(F.greatest(F.size(f"s_{k}") - 1, F.lit(0)) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(f"s_{k}", b * _BLOCK + 1, F.lit(_BLOCK))))

    texts = texts.select("*", *(step(k).alias(f"s_{k}") for k in kinds))
    texts = texts.select("*", *(block(k).alias(f"b_{k}") for k in kinds))

    def candidate(k):
        def at(m, i):
            block = F.floor(i / _BLOCK).cast("int")
            piece = F.get(f"p_{k}", i)
            start = total(F.slice(f"b_{k}", F.lit(1), block)) + total(F.slice(f"s_{k}", block * _BLOCK + 1, i % _BLOCK)) + F.length(piece)
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m"), F.right(piece, F.lit(CONTEXT)).alias("before"))

        return F.transform(f"f_{k}", at)

    texts = texts.select("*", *(candidate(k).alias(f"c_{k}") for k in kinds))
    return texts.drop(*(f"{x}_{k}" for k in kinds for x in "fpsb"))


def _examples(spark: SparkSession, kind: str) -> DataFrame:
    """Made-up texts with the span in them and its kind, null where it is nobody's data; derived from the row number.

    Context words, the form and the check digits each speak for the truth often, none of them always.
    """
    i = F.col("id")
    draw = lambda salt, n: F.pmod(F.xxhash64(i, F.lit(kind), F.lit(salt)), F.lit(n))
    digits = lambda salt, n: F.lpad(draw(salt, 10**n).cast("string"), n, "0")
    pick = lambda salt, *words: F.element_at(F.array(*(w if isinstance(w, Column) else F.lit(w) for w in words)), (draw(salt, len(words)) + 1).cast("int"))
    speaks = {
        "ssn": ("his SSN is ", "social security number: ", "national id ", "tax id "),
        "iban": ("pay to IBAN ", "bank account ", "compte ", "Konto: "),
        "tel": ("call me at ", "phone: ", "tel ", "mobile ", "reach him on "),
        "mail": ("write to ", "my e-mail is ", "contact ", "send it to "),
    }[kind]
    other = ("part no. ", "see order ", "version ", "ref ", "lot ", "invoice ", "page ", "on the date ")
    plain = ("and then ", "so it was ", "they noted ", "")
    truly = draw(1, 2) == 0
    mark = pick(3, "-", " ", ".")
    if kind == "ssn":
        sound = F.concat((draw(2, 500) + 100).cast("string"), mark, (draw(4, 89) + 10).cast("string"), mark, (draw(5, 8999) + 1000).cast("string"))
        broken = pick(6, F.concat(pick(2, "000", "666", "912"), mark, digits(4, 2), mark, digits(5, 4)), digits(4, 9), sound)
    elif kind == "tel":
        sound = pick(
            6,
            F.concat((draw(2, 700) + 200).cast("string"), mark, (draw(4, 700) + 200).cast("string"), pick(7, "-", "."), digits(5, 4)),
            F.concat(F.lit("0"), digits(2, 2), mark, digits(4, 3), mark, digits(5, 4)),
            F.concat(F.lit("0"), digits(2, 1), mark, digits(4, 2), mark, digits(5, 2), mark, digits(8, 2), mark, digits(9, 2)),
            F.concat(F.lit("("), (draw(2, 700) + 200).cast("string"), F.lit(") "), (draw(4, 700) + 200).cast("string"), F.lit("-"), digits(5, 4)),
        )
        broken = pick(
            10,
            F.concat(pick(2, "012", "100"), F.lit("."), digits(4, 3), F.lit("."), digits(5, 4)),
            F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), draw(4, 14000).cast("int")), "yyyy-MM-dd"),
            F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), draw(4, 14000).cast("int")), "dd.MM.yyyy"),
            F.concat(digits(4, 2), F.lit("."), digits(5, 2), F.lit("."), digits(8, 2), F.lit("."), digits(9, 2)),
            sound,
        )
    elif kind == "mail":
        name, host, end = pick(2, "ann", "jo.smith", "mx_7", "info"), pick(4, "example", "mail-7", "host"), pick(6, "org", "com", "net", "de")
        sound = pick(
            7,
            F.concat(name, pick(3, " [at] ", "(at)", " (at) "), host, pick(5, " [dot] ", "(dot)", "."), end),
            F.concat(name, F.lit(" at "), host, F.lit(" dot "), end),
        )
        broken = F.concat(pick(2, "met", "look", "is", "left"), F.lit(" at "), pick(4, "noon", "home", "file", "dot"), pick(5, ".", " dot "), pick(6, "then", "txt", "she", "com"))
    else:
        body = F.concat(digits(2, 9), digits(3, 9))
        # check digits from the remainder of body, letters as numbers (D 13, E 14), and two zeros
        rest = F.aggregate(F.split(F.concat(body, F.lit("131400")), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * 10 + F.ascii(c) - 48) % 97))
        shaped = lambda x: pick(5, x, F.rtrim(F.regexp_replace(x, "(.{4})", "$1 ")))
        sound = shaped(F.concat(F.lit("DE"), F.lpad((98 - rest).cast("string"), 2, "0"), body))
        broken = shaped(F.concat(F.lit("DE"), digits(4, 2), body))
    m = F.when(truly, sound).otherwise(broken)
    true_lead = F.when(draw(11, 10) < 8, pick(12, *speaks)).otherwise(pick(13, *plain))
    false_lead = F.when(draw(11, 10) < 1, pick(12, *speaks)).when(draw(11, 10) < 7, pick(13, *other)).otherwise(pick(14, *plain))
    lead = F.when(truly, true_lead).otherwise(false_lead)
    own = spark.range(0, EXAMPLES // len(MORE), 1, 1).select(i, lead.alias("lead"), m.alias("m"), F.when(truly, F.lit(kind)).alias("kind"))
    start = F.length("lead")
    truths = F.when(F.col("kind").isNotNull(), F.array(F.concat_ws(":", "kind", start.cast("string"), (start + F.length("m")).cast("string")))).otherwise(F.array().cast("array<string>"))
    return own.select(F.concat("lead", "m", pick(15, ".", ", and so on", " ", "; the rest follows")).alias("text"), truths.alias("truths"))


def _sentences(spark: SparkSession, marked: dict) -> DataFrame:
    """The texts of marked sentences without their brackets, and the spans that stood in them."""
    rows = []
    for kind, own in marked.items():
        for sentence in own:
            text, truths = "", []
            for n, piece in enumerate(re.split(r"\[\[(.*?)\]\]", sentence)):
                if n % 2:
                    truths.append(f"{kind}:{len(text)}:{len(text) + len(piece)}")
                text += piece
            rows.append(F.struct(F.lit(text).alias("text"), F.array(*map(F.lit, truths)).cast("array<string>").alias("truths")))
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def _boost(x: np.ndarray, y: np.ndarray) -> list[Tree]:
    """Trees of depth two by Newton steps on the logistic loss."""
    cuts = [(f, float(t)) for f in range(x.shape[1]) for t in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 13)))[1:]]
    below = [x[:, f] < t for f, t in cuts]
    score, trees = np.zeros(len(x)), []

    def grow(rows, g, h, depth):
        whole = g[rows].sum(), h[rows].sum()
        best, gain = None, 1e-9
        for n, low in enumerate(below if depth else []):
            gl, hl = g[rows & low].sum(), h[rows & low].sum()
            own = gl**2 / (hl + 1) + (whole[0] - gl) ** 2 / (whole[1] - hl + 1) - whole[0] ** 2 / (whole[1] + 1)
            if own > gain:
                best, gain = n, own
        if best is None:
            return float(RATE * whole[0] / (whole[1] + 1))
        return (*cuts[best], grow(rows & below[best], g, h, depth - 1), grow(rows & ~below[best], g, h, depth - 1))

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        trees.append(tree := grow(np.ones(len(x), bool), y - p, p * (1 - p), 2))
        score += [value(tree, r) for r in x]
    return trees


def value(tree: Tree | float, row) -> float:
    while not isinstance(tree, float):
        f, t, low, high = tree
        tree = low if row[f] < t else high
    return tree


def _described(name: str) -> Column:
    """The proposals of a generator with their features."""

    def one(x):
        features = F.struct(*(c.alias(n) for n, c in zip(FEATURES, _features(name, x["m"], x["before"]))))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), features.alias("f"))

    return F.transform(f"c_{name}", one)


def _labelled(texts: DataFrame) -> list[list[float]]:
    """Features and label of each proposal in texts of known spans; the driver holds them, so texts must be bounded."""
    own = _proposed(texts, GENERATORS)

    def named(name):
        return F.transform(_described(name), lambda x: F.struct(F.lit(name[:-1]).alias("name"), x["start"].alias("start"), x["end"].alias("end"), x["f"].alias("f")))

    frame = own.select("truths", F.inline(F.concat(*map(named, GENERATORS))))
    label = F.array_contains("truths", F.concat_ws(":", "name", F.col("start").cast("string"), F.col("end").cast("string")))
    return [[float(v) for v in r] for r in frame.select("f.*", label.cast("int").alias("label")).orderBy(*FEATURES, "label").collect()]


def train(spark: SparkSession) -> tuple[list[Tree], dict[str, float]]:
    """Boosted trees and the threshold of each kind's scores."""
    frame = _examples(spark, next(iter(MORE)))
    for kind in list(MORE)[1:]:
        frame = frame.union(_examples(spark, kind))
    learn = np.array(_labelled(frame))  # a few proposals for each of EXAMPLES rows
    trees = _boost(learn[:, :-1], learn[:, -1])
    scored = sorted(((int(r[0]), sum(value(t, r[:-1]) for t in trees), r[-1]) for r in _labelled(_sentences(spark, SENTENCES))), reverse=True)
    thresholds = {}
    for k, kind in enumerate(MORE):
        own = [x[1:] for x in scored if x[0] == k]
        thresholds[kind], right = own[0][0], 0.0
        for n, (score, label) in enumerate(own, 1):
            right += label
            if label and right / n >= PRECISION and (n == len(own) or own[n][0] < score):
                thresholds[kind] = score
    return trees, thresholds


def _scored(trees: list[Tree], features: list[Column]) -> Column:
    def column(tree):
        if isinstance(tree, float):
            return F.lit(tree)
        f, t, low, high = tree
        return F.when(features[f] < t, column(low)).otherwise(column(high))

    return sum((column(t) for t in trees[1:]), column(trees[0]))


def _named(k: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string")))


def _kept_base(k: str) -> Column:
    return _named(k, F.filter(f"c_{k}", lambda x: _passes(k, x["m"])))


def _passing(trees: list[Tree], thresholds: dict[str, float]) -> Column:
    """The proposals of all generators that reach their kind's threshold, by start; rank orders those that overlap."""

    def ranked(name):
        kind, wide = list(MORE).index(name[:-1]), int(name[-1])

        def one(x):
            score = _scored(trees, [x["f"][n] for n in FEATURES])
            rank = F.struct(score.alias("score"), (x["end"] - x["start"]).alias("size"), (-x["start"]).alias("first"), F.lit(-kind).alias("kind"), F.lit(-wide).alias("wide"))
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), rank.alias("rank"))

        return F.filter(F.transform(_described(name), one), lambda x: x["rank"]["score"] >= F.lit(thresholds[name[:-1]] - 1e-9))

    return F.array_sort(F.concat(*map(ranked, GENERATORS)))


def _selected(texts: DataFrame) -> DataFrame:
    """Of the proposals `passed`, those that stand: one gives way only to an overlapping one that no other beats.

    So each proposal that passed stands or overlaps one that does, also along chains of overlaps.
    """

    def near(name, i):
        return F.slice(name, F.greatest(i - NEAR, F.lit(0)) + 1, F.lit(2 * NEAR + 1))

    def overlaps(x, y):
        return (x["start"] < y["end"]) & (y["start"] < x["end"])

    def judged(x, i):
        beaten = F.exists(near("passed", i), lambda y: overlaps(x, y) & (y["rank"] > x["rank"]))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["rank"]["kind"].alias("kind"), (~beaten).alias("won"))

    texts = texts.withColumn("judged", F.transform("passed", judged)).drop("passed")
    stands = F.filter("judged", lambda x, i: x["won"] | ~F.exists(near("judged", i), lambda y: y["won"] & overlaps(x, y)))
    return texts.withColumn("stands", stands).drop("judged")


def _of_kind(kind: str) -> Column:
    return F.filter("stands", lambda x: x["kind"] == -list(MORE).index(kind))


_TRAINED: dict[str, tuple] = {}


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (of all kinds) of each row of docs.

    A null text counts as empty and has no span. Rows that repeat come back as often; an empty table gives no rows;
    other columns are not read. Spans of a base kind don't overlap each other but may overlap others. Of further kinds'
    proposals that overlap the best score stands, then the longest, the first, and the kind that MORE lists first.
    """
    spark = docs.sparkSession
    if "model" not in _TRAINED:
        _TRAINED["model"] = train(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = _proposed(own, BASE | GENERATORS).drop("text")
    own = _selected(own.select("doc_id", *(_kept_base(k).alias(k) for k in BASE), _passing(*_TRAINED["model"]).alias("passed")))
    more = [_named(k, _of_kind(k)) for k in MORE]
    found = own.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.concat_ws(",", *BASE), 256).alias("base_sha256"),
        F.concat_ws(",", *BASE, *more).alias("spans"),
        (sum((F.size(k) for k in BASE), F.lit(0)) + F.size("stands")).cast("long").alias("n_spans"),
    )
    # stored, as a filter behind it would else be pushed below and do all the work twice
    return Scratch(spark).keep(found)
