"""The versioned table: pruning, merges, commits, differences, streams."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from noticemill.operators import numbering, store, versions
from noticemill.plans import listing
from noticemill.schema import align
from noticemill.sources.fixtures import AS_OF, notices
from noticemill.stored import Scratch
from noticemill.streaming.upserts import stream_upserts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def some(spark):
    return spark.createDataFrame(align(notices(spark, SF)).where("id < 400").collect(), align(notices(spark, SF)).schema).cache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def day(text):
    return F.lit(text).cast("date")


def rows_of(df):
    return sorted((r.link, r.titulo, r.data, r.preco_base, str(r.data_publicacao), str(r.preco)) for r in df.collect())


def spoil(path):
    with open(path, "wb") as f:
        f.write(b"x")
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(crc):
        os.remove(crc)


def changed(some):
    return some.selectExpr("link", "concat('N ', id) as titulo", "case when id % 4 = 0 then '15-06-2001' end as data", "' ' as preco_base").where("cast(substring_index(link, '=', -1) as int) % 5 = 0")


def test_period_reads_its_months_only(spark, some, tmp_path):
    v = versions.create(spark, str(tmp_path / "t"), some)
    rows = versions.read(spark, v)
    assert rows.count() == some.count()
    found = versions.published(rows, day("2001-05-01"), day("2001-07-01"))
    assert "PartitionFilters: [isnotnull(mes" in plan(found) and "(mes#" in plan(found).split("PartitionFilters:")[1].split("]")[0]
    want = {r.id for r in versions.typed_rows(some, 4).where("data_publicacao >= '2001-05-01' and data_publicacao < '2001-07-01'").collect()}
    assert {r.id for r in found.collect()} == want and want
    recent = versions.since(rows, day("2001-05-20"))
    later = {r.id for r in versions.typed_rows(some, 4).where("data_publicacao is null or data_publicacao >= '2001-05-20'").collect()}
    for path in glob.glob(f"{tmp_path}/t/data/*/mes=*/*/*.parquet"):  # whoever opens one of these fails
        if "mes=200105" not in path and "mes=200106" not in path and "mes=0" not in path and "mes=200107" not in path:
            spoil(path)
    assert {r.id for r in found.collect()} == want
    assert {r.id for r in recent.collect()} == later
    with pytest.raises(Exception):
        rows.agg(F.max("titulo")).collect()


def test_joins_on_link_do_not_exchange_the_store(spark, some, tmp_path):
    v = versions.create(spark, str(tmp_path / "t"), some, buckets=3)
    new = changed(some)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = versions.read(spark, v).join(new, "link", "left_semi")
        text = plan(joined)
        assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") == 1, text
        assert "Bucketed: true" in text or "SelectedBucketsCount" in text
        link = some.first().link
        one = versions.by_link(versions.read(spark, v), v, link)
        assert "isnotnull(parte" in plan(one).split("PartitionFilters:")[1].split("]")[0] and one.count() == 1
        # who opens another part or another bucket fails
        own = spark.sql(f"select pmod(hash('{link}'), 3) as b, pmod(xxhash64('{link}'), 4) as p").first()
        for path in glob.glob(f"{tmp_path}/t/data/*/mes=*/*/*.parquet"):
            if f"parte={own.p}/" not in path or f"_0000{own.b}." not in path:
                spoil(path)
        assert one.count() == 1 and one.first().link == link
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_merge_rewrites_what_it_touches(spark, some, tmp_path):
    root = str(tmp_path / "t")
    first = versions.create(spark, root, some.where("id % 2 = 0"))
    few = spark.createDataFrame([(r.link, "Outro") for r in some.where("id % 2 = 0 and data like '%2001%'").limit(2).collect()], "link string, titulo string")
    second = versions.merge(spark, first, few)
    assert 1 <= len(set(second.folders) - set(first.folders)) <= 2 and len(second.folders) == len(first.folders)
    assert {r.titulo for r in versions.read(spark, second).join(few.select("link"), "link").collect()} == {"Outro"}
    assert rows_of(versions.read(spark, first)) == rows_of(versions.typed_rows(some.where("id % 2 = 0"), 4))  # the old version stays
    counts = versions.change_counts(versions.changes(spark, first, second)).first()
    assert tuple(counts) == (0, 2, 0)


def test_merge_equals_upsert_and_insert(spark, some, tmp_path):
    base, new = some.where("id % 2 = 0"), changed(some)
    v = versions.merge(spark, versions.create(spark, str(tmp_path / "t"), base), new)
    known, fresh = store.already_in(new, base), store.not_in(new, base)
    want = store.insert_new(store.upsert(base, known), fresh)
    got = versions.read(spark, v)
    assert rows_of(got) == rows_of(versions.typed_rows(want, 4))
    ids = [r.id for r in got.collect()]
    assert len(set(ids)) == len(ids) and v.top == max(ids)
    none = versions.merge(spark, v, new.limit(0))
    assert none.folders == v.folders
    strange = spark.createDataFrame([(None, "x"), (" ", "y"), ("new", "a"), ("new", "b")], "link string, titulo string")
    w = versions.merge(spark, none, strange.withColumn("n", F.lit(1)), order=None)
    assert [r.titulo for r in versions.read(spark, w).where("link = 'new'").collect()] == ["b"]
    assert versions.read(spark, w).count() == len(ids) + 1


def test_single_updates_are_folded_like_others(spark):
    rows = [("a", "x", " ", 1), ("b", "y", "1", 2), ("b", "z", None, 3), ("b", " ", "2", 1), (" ", "n", "n", 1), (None, "n", "n", 1), ("c", None, "\u00a0", 1)]
    df = spark.createDataFrame(rows, "link string, titulo string, data string, n int")
    for some, order in ((df, None), (df, "n"), (df.where("link <> 'b'"), None), (df.where("link <> 'b'"), "n"), (df.select("link"), None)):
        want = store.folded(some, "link", order).drop("_rows")
        got = versions._one_each(Scratch(spark), some, order)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_rows_that_share_a_link_move_together(spark, some, tmp_path):
    base = some.where("id < 40")
    twin = base.where("id = 7").withColumn("id", F.lit(1000).cast("long")).withColumn("titulo", F.lit("Novo"))
    first = versions.create(spark, str(tmp_path / "t"), base.unionByName(twin), buckets=2, parts=1)
    link = twin.first().link
    second = versions.merge(spark, first, spark.createDataFrame([(link, "Novo", "15-06-2001")], "link string, titulo string, data string"))
    got = versions.read(spark, second)
    assert sorted((r.id, r.titulo, r.mes) for r in got.where(F.col("link") == link).collect()) == [(7, "Novo", 200106), (1000, "Novo", 200106)]
    assert got.count() == base.count() + 1
    third = versions.merge(spark, second, spark.createDataFrame([(link, "Novo")], "link string, titulo string"))
    assert third == second  # nothing differs
    # of two rows of a link only one differs
    fourth = versions.create(spark, str(tmp_path / "u"), base.unionByName(twin), buckets=2, parts=1)
    fifth = versions.merge(spark, fourth, spark.createDataFrame([(link, "Novo")], "link string, titulo string"))
    assert sorted((r.id, r.titulo) for r in versions.read(spark, fifth).where(F.col("link") == link).collect()) == [(7, "Novo"), (1000, "Novo")]
    assert versions.read(spark, fifth).count() == base.count() + 1


def test_updates_that_change_nothing_write_nothing(spark, some, tmp_path):
    root = str(tmp_path / "t")
    v = versions.create(spark, root, some.withColumn("titulo", F.trim("titulo")))
    same = some.select("link", "titulo", "data", F.lit(" ").alias("preco_base"))
    assert versions.merge(spark, v, same) == v
    noted = versions.merge(spark, v, same, batch=("s", 0))
    assert noted.folders == v.folders and noted.number == 2 and versions.merge(spark, noted, same, batch=("s", 0)) == noted
    twice = some.limit(1).union(some.limit(1).withColumn("id", F.lit(9000).cast("long")).withColumn("titulo", F.lit("B")))
    w = versions.create(spark, str(tmp_path / "d"), twice)
    after = versions.merge(spark, w, some.limit(1).select("link", F.lit("B").alias("titulo")))
    assert [r.titulo for r in versions.read(spark, after).collect()] == ["B", "B"]


def test_of_two_writers_one_commits(spark, some, tmp_path):
    root = str(tmp_path / "t")
    v = versions.create(spark, root, some)
    link = some.first().link
    versions.merge(spark, v, spark.createDataFrame([(link, "A")], "link string, titulo string"))
    with pytest.raises(versions.CommitConflict):
        versions.merge(spark, v, spark.createDataFrame([(link, "B")], "link string, titulo string"))
    with pytest.raises(versions.CommitConflict):
        versions.create(spark, root, some)
    w = versions.merge_retrying(spark, root, spark.createDataFrame([(link, "1 €")], "link string, preco_base string"))
    row = versions.by_link(versions.read(spark, w), w, link).first()
    assert (w.number, row.titulo, row.preco_base, row.preco) == (3, "A", "1 €", 1)
    versions.vacuum(spark, root, keep=1)
    assert rows_of(versions.read(spark, versions.latest(spark, root))) == rows_of(versions.read(spark, w))
    with pytest.raises(Exception):
        versions.at(spark, root, 1)
    with pytest.raises(FileNotFoundError):
        versions.latest(spark, str(tmp_path / "none"))


def test_difference_is_null_safe(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, None, None), (4, "z", 4)], "id int, t string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (3, "", None), (5, "n", 5)], "id int, t string, n int")
    assert sorted(map(tuple, versions.difference(a, b).collect())) == [(2, "updated"), (3, "updated"), (4, "deleted"), (5, "inserted")]


class Killed(Exception):
    pass


@pytest.mark.parametrize("when", ["before", "after"])
def test_stream_goes_on_after_a_killed_run(spark, some, tmp_path, monkeypatch, when):
    base, new = some.where("id % 2 = 0"), changed(some)
    new.repartition(3, "link").write.parquet(str(tmp_path / "landed"))
    source = lambda: spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landed"))
    root, state = str(tmp_path / "t"), str(tmp_path / "state")
    versions.create(spark, root, base)
    merge, calls = versions.merge_retrying, []

    def dies(*args, **options):
        calls.append(options["batch"])
        if len(calls) == 2 and when == "before":
            raise Killed
        out = merge(*args, **options)
        if len(calls) == 2:
            raise Killed
        return out

    monkeypatch.setattr(versions, "merge_retrying", dies)
    with pytest.raises(Exception):
        stream_upserts(source(), root, "s", state)
    after = stream_upserts(source(), root, "s", state)
    assert after.number == 4 and dict(after.batches) == {"s": 2}  # one version a batch, none twice
    whole = versions.merge(spark, versions.create(spark, str(tmp_path / "w"), base), new)
    assert rows_of(versions.read(spark, after)) == rows_of(versions.read(spark, whole))


def test_stream_that_skips_what_is_stored(spark, some, tmp_path):
    some.selectExpr("link", "'N' as titulo").coalesce(1).write.parquet(str(tmp_path / "landed"))
    root = str(tmp_path / "t")
    versions.create(spark, root, some.where("id % 2 = 0"))
    source = spark.readStream.schema("link string, titulo string").parquet(str(tmp_path / "landed"))
    after = versions.read(spark, stream_upserts(source, root, "s", str(tmp_path / "state"), update=False))
    assert after.where("titulo = 'N'").count() == some.where("id % 2 = 1").count() and after.count() == some.count()


def test_listing_pages_are_top_k(spark):
    for number in (1, 2):
        text = plan(listing.listing(notices(spark, SF), day(AS_OF), number)[0])
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text, text


@pytest.mark.parametrize("parts", [1, 7])
def test_numbering(spark, parts):
    rows = [(i % 5, "x") for i in range(200)] + [(3, "x")] * 300 + [(None, "y")]
    df = spark.createDataFrame(rows, "n int, _numbered string")
    got = numbering.numbered(df, F.desc_nulls_last("n"), parts=parts).collect()
    assert sorted(r.posicao for r in got) == list(range(1, len(rows) + 1))
    ordered = [r.n for r in sorted(got, key=lambda r: r.posicao)]
    assert ordered == sorted((n for n, _ in rows), key=lambda n: (n is None, -(n or 0)))
    assert numbering.numbered(df.limit(0), F.desc("n")).count() == 0
    if parts > 1:  # a value that most rows share is split
        dealt = spark.createDataFrame([(3,)] * 5000, "n int")
        ids = numbering.numbered(dealt, F.asc("n"), parts=parts)
        assert sorted(r.posicao for r in ids.collect()) == list(range(1, 5001))


def test_listing_of_the_table_parses_nothing_and_skips_what_has_ended(spark, some, tmp_path):
    rows = versions.read(spark, versions.create(spark, str(tmp_path / "t"), some))
    for period in ("atual", "historico"):
        stored, parsed = (listing.listing(x, day(AS_OF), 1, 50, period=period) for x in (rows, some))
        assert stored[0].collect() == parsed[0].collect() and stored[1].first() == parsed[1].first()
        text = plan(stored[0])
        assert "data_fim" in text.split("PushedFilters:")[1].split("]")[0] and "gettimestamp" not in text and "regexp" not in text.split("FileScan")[1]
