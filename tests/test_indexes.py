"""Pages by key, substring index, phrases under fragments, monthly increments, landed pages, bounded streams."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from noticemill import lexicon as L
from noticemill.functions import phrases, text
from noticemill.operators import aggregate, filters, measures, project, search_index, versions
from noticemill.plans import listing, paging
from noticemill.schema import align
from noticemill.sources import pages
from noticemill.sources.fixtures import AS_OF, notices, raw_notices
from noticemill.streaming import lookback
from test_versions import day, plan, spoil

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def some(spark):
    rows = align(notices(spark, SF)).where("id < 400")
    return spark.createDataFrame(rows.collect(), rows.schema).cache()


@pytest.mark.parametrize("block", [7, 100, 10_000])
def test_pages_by_key_equal_offset_pages(spark, some, block):
    rows = project.typed(some, day(AS_OF)).cache()
    given = paging.borders(rows, block)
    for number, size in ((1, 20), (2, 20), (5, 33), (9, 50), (len(some.collect()) // 10 + 1, 10), (99, 100)):
        want = [r.id for r in listing.page(rows, number, size).collect()]
        assert [r.id for r in paging.page_by_key(rows, given, number, size).collect()] == want
    assert paging.page_by_key(rows.limit(0), paging.borders(rows.limit(0)), 1, 20).count() == 0
    with pytest.raises(ValueError):
        paging.page_by_key(rows, given, 0, 20)


def test_pages_by_key_read_their_months_only(spark, some, tmp_path):
    rows = versions.read(spark, versions.create(spark, str(tmp_path / "t"), some))
    got = paging.page_by_key(rows, paging.borders(rows, 20), 3, 20)
    want = [r.id for r in got.collect()]
    months = {r.mes for r in rows.where(F.col("id").isin(want)).select("mes").distinct().collect()}
    assert "mes#" in plan(got).split("PartitionFilters:")[1].split("]")[0]
    near = {m + d for m in months for d in (-1, 0, 1)}
    for path in glob.glob(f"{tmp_path}/t/data/*/mes=*/*/*.parquet"):
        month = int(path.split("mes=")[1].split("/")[0])
        if month and month not in near and month // 100 < 2001:
            spoil(path)
    assert [r.id for r in got.collect()] == want and len(want) == 20


def test_search_index_equals_the_scan(spark, tmp_path):
    words = ["Museu de Évora", "museu", "a", "", None, "REDE de água", "ab", "ba", "İx", "xx xx", "\t", "ção"]
    rnd = random.Random(1)
    rows = spark.createDataFrame([(i, rnd.choice(words), rnd.choice(words), "".join(rnd.choices("ab é", k=5))) for i in range(300)], "id long, titulo string, entidade string, cpv string").cache()
    index = search_index.build(rows, str(tmp_path / "i"), parts=5, salt=3)
    for term in ["museu", " MUSEU ", "a", "ab", "é", "de Évora", "ção", "zzz", "", "  ", "xx xx", "aba", "b é", "museu de évora", "u de"]:
        want = sorted(r.id for r in rows.where(filters.contains_text(term, "titulo", "entidade", "cpv")).collect())
        assert sorted(r.id for r in search_index.search(rows, index, term).collect()) == want, term
    found = search_index.candidates(spark, index, "museu")
    assert "part#" in plan(found).split("PartitionFilters:")[1].split("]")[0]
    none = search_index.build(rows.limit(0), str(tmp_path / "e"))
    assert search_index.search(rows.limit(0), none, "a").count() == 0


def test_search_index_keeps_each_text_once(spark, tmp_path):
    titles = ["Museu de Évora", "Rede de água", "Escola"]
    rows = spark.range(3000).selectExpr("id", f"array({', '.join(map(repr, titles))})[cast(id % 3 AS int)] AS titulo", "CAST(NULL AS string) AS entidade", "'Museu de Évora' AS cpv").cache()
    index = search_index.build(rows, str(tmp_path / "i"), parts=5)
    grams = lambda t: {t[i : i + n].lower() for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    postings = spark.read.parquet(f"{index.root}/postings")
    assert postings.count() == sum(len(grams(t)) for t in titles)  # not of each row
    assert spark.read.parquet(f"{index.root}/holders").count() == 3000 + 2000  # a row whose columns say the same holds it once
    for term, n in {"museu": 3000, "rede de": 1000, "escola": 1000, "esc rede": 0}.items():
        assert search_index.search(rows, index, term).count() == n, term
    # more texts than all tasks are to get
    keep, search_index.BROADCAST = search_index.BROADCAST, 0
    try:
        assert search_index.search(rows, index, "e de").count() == 1000 and search_index.search(rows, index, "de").count() == 3000
    finally:
        search_index.BROADCAST = keep


LISTS = [L.EXPLICIT, L.DESIGN_ACTION, L.COORDINATION, L.EXCLUSION, L.SUPERVISION, L.ENGINEERING, L.STRONG_WORDS, L.PROJECT_WORDS, L.BUILDING_WORDS, L.SERVICE_WORDS, L.COMPETITION_WORDS]


def test_phrases_under_fragments_are_those_of_the_list(spark):
    rnd = random.Random(2)
    every = [w for words in LISTS for w in words]
    texts = ["", None, *every, *(" ".join(rnd.choice([rnd.choice(every), rnd.choice(every)[:9], rnd.choice(every)[3:], "de", "x"]) for _ in range(rnd.randint(1, 8))) for _ in range(300))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for words in [*LISTS, ["a", "aa", "aaa"], ["x"], ["abcdefgh", "bcdefghi", "cdefghij", "defghijk", "efghijkl", "fghijklm"]]:
        out = df.select("t", phrases.indexed_matches(F.col("t"), words).alias("m"), phrases.any_indexed(F.col("t"), words).alias("a"))
        for r in out.collect():
            want = None if r.t is None else [w for w in dict.fromkeys(words) if w in r.t]
            assert r.m == want and r.a == (None if r.t is None else bool(want))


def test_fragments_cover_every_phrase_once():
    for words in LISTS:
        groups = phrases.grouped(tuple(dict.fromkeys(words)))
        assert sorted(w for _, own in groups for w in own) == sorted(set(words))
        assert all(f in w for f, own in groups for w in own) and len(groups) < len(set(words))


def test_increments_equal_the_recomputation(spark, some, tmp_path):
    version = versions.create(spark, str(tmp_path / "t"), some.where("id % 2 = 0"), buckets=2, parts=1)
    kept = measures.partials(versions.read(spark, version))
    batches = [
        some.where("id % 3 = 0").selectExpr("link", "case when id % 4 = 0 then '15-06-2001' end as data", "'1 €' as preco_base"),
        some.where("id % 2 = 1").select("link", "titulo", "data", "entidade", "preco_base", "data_limite"),
        some.where("id % 7 = 0").selectExpr("link", "'Outra' as entidade", "'02/05/1999' as data", "'x' as preco_base"),
    ]
    for batch in batches:
        after = versions.merge(spark, version, batch)
        kept, version = spark.createDataFrame((k := measures.advanced_to(spark, kept, version, after)).collect(), k.schema), after
        rows = versions.read(spark, version)
        whole = aggregate.monthly(project.typed(rows, day(AS_OF)))
        columns = ["mes", "total", "entidades", "com_preco", "valor_total", "com_prazo"]
        pick = lambda df: sorted(tuple(str(r[c]) for c in columns) for r in df.withColumn("mes", F.col("mes").cast("date")).collect())
        assert pick(measures.monthly(kept)) == pick(whole)
        assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, measures.partials(rows).collect()), key=str)
    top = measures.top_of_month(kept, 199905, 3).collect()
    assert top and top[0].entidade == "Outra"


def test_landed_pages_are_read_up_to_the_first_old_row(spark, some, tmp_path):
    raw, root = raw_notices(some), str(tmp_path / "p")
    pages.land_pages(raw, root, 10)
    last = max(int(p.split("page=")[1]) for p in glob.glob(f"{root}/page=*"))
    oldest = day("2001-05-15")
    rows = raw.collect()
    parsed = {r.id: r.data_publicacao for r in project.typed(some, day(AS_OF)).select(F.col("id").cast("string").alias("id"), "data_publicacao").collect()}
    want = {r.id for r in rows if parsed[r.id] is None or str(parsed[r.id]) >= "2001-05-15"}
    landed = spark.read.schema(raw.schema.add("position", "long").add("page", "integer")).json(root)
    stop = pages.pages_needed(landed, oldest, 10, first=2)
    assert stop == len(want) // 10 + 1 < last
    assert pages.pages_needed(landed, day("1900-01-01"), 10) in (last, last + 1) and pages.pages_needed(landed, oldest, 10, most=3) == 3
    for path in glob.glob(f"{root}/page=*/*"):
        if int(path.split("page=")[1].split("/")[0]) > 4 * stop + 8:
            spoil(path)
    got = pages.read_recent(spark, root, raw_notices(some).schema, day("2001-05-22"), 7, 10)
    assert {r.id for r in got.collect()} == want
    assert "PartitionFilters: [isnotnull(page" in plan(got)


def test_state_shrinks_and_late_rows_are_counted(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts")).cache()
    for i in range(1, 31):
        events.where(F.dayofmonth("ts") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = events.where(F.dayofmonth("ts") == 12)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    oldest = F.lit("2024-01-10").cast("timestamp")
    done = lookback.run_within(spark, source, ["event_id"], "ts", oldest, str(tmp_path / "out"), str(tmp_path / "state"), "2 days")
    want = sorted(r.event_id for r in events.where(F.col("ts") >= oldest).collect())
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    assert done.dropped_late == late.count() and done.batches >= 31
    assert max(done.state_rows) < len(want) / 3 and done.state_rows[-1] < max(done.state_rows)
    again = lookback.run_within(spark, source, ["event_id"], "ts", oldest, str(tmp_path / "out"), str(tmp_path / "state"), "2 days")
    assert again.rows_read == 0
