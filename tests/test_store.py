"""Store, overlay, sources and stream: invariants."""

import json

import pytest
from pyspark.sql import functions as F

from noticemill.operators import project, store
from noticemill.plans import listing
from noticemill.schema import STORED, align
from noticemill.sources import notices as source
from noticemill.sources.fixtures import AS_OF, notices
from noticemill.stored import CommitConflict
from noticemill.streaming.ingest import ingest_distinct

SF = "/root/testdata/sf0.001"


def base(spark):
    return align(spark.createDataFrame([(1, "a", "l1", "10", None), (2, "b", "l2", None, "x")], "id long, titulo string, link string, preco_base string, data_limite string"))


def test_upsert_coalesces_and_is_idempotent(spark):
    new = spark.createDataFrame([("l1", " ", "d1"), ("l2", "20", None)], "link string, preco_base string, data_limite string")
    once = store.upsert(base(spark), new)
    rows = {r.link: (r.id, r.preco_base, r.data_limite) for r in once.collect()}
    assert rows == {"l1": (1, "10", "d1"), "l2": (2, "20", "x")}
    assert sorted(store.upsert(once, new).collect()) == sorted(once.collect())


def test_insert_new_deals_ids(spark):
    new = spark.createDataFrame([("n1", "l2"), ("n2", "l3"), ("n3", "l4"), ("n4", "l3")], "titulo string, link string")
    out = store.insert_new(base(spark), new)
    assert out.schema.names == STORED.names
    rows = out.collect()
    assert sorted(r.link for r in rows) == ["l1", "l2", "l3", "l4"]
    assert sorted(r.id for r in rows) == [1, 2, 3, 4]
    assert store.insert_new(out, new).count() == 4


def test_keep_first_leaves_blank_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, ""), (5, None)], "n int, k string")
    assert sorted(r.n for r in store.keep_first(rows, ["k"], "n").collect()) == [1, 3, 4, 5]


def test_overlay_ignores_empty_but_not_zero(spark):
    left = spark.createDataFrame([(1, "a", 5, ["x"]), (2, "b", 6, ["y"])], "id int, t string, n int, l array<string>")
    right = spark.createDataFrame([(1, "", 0, [])], "id int, t string, n int, l array<string>")
    assert [tuple(r) for r in project.overlay(left, right).orderBy("id").collect()] == [(1, "a", 0, ["x"]), (2, "b", 6, ["y"])]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "s")
    store.write_snapshot(base(spark), root)
    store.write_snapshot(base(spark).where("id = 1"), root)
    assert store.read_snapshot(spark, root).count() == 1
    with pytest.raises(FileNotFoundError):
        store.read_snapshot(spark, str(tmp_path / "none"))
    assert store.read_snapshot(spark, root, 1).count() == 2 and store.snapshot_number(spark, root) == 2
    store.write_snapshot(base(spark), root, after=2)
    with pytest.raises(CommitConflict):  # made from the second one, which has a successor
        store.write_snapshot(base(spark).limit(0), root, after=2)
    assert store.snapshot_number(spark, root) == 3 and store.read_snapshot(spark, root).count() == 2


def test_several_updates_for_a_key_are_one(spark):
    new = spark.createDataFrame([(1, "l1", "5", None, "A"), (2, "l1", " ", "d1", " "), (3, "l3", "9 €", "d", "B"), (4, "l3", "10 €", None, None), (5, None, "x", "x", "x"), (6, " ", "x", "x", "x")], "n int, link string, preco_base string, data_limite string, titulo string")
    rows = sorted((r.link, r.titulo, r.preco_base, r.data_limite) for r in store.upsert(base(spark), new, order="n").collect())
    assert rows == [("l1", "A", "5", "d1"), ("l2", "b", None, "x"), ("l3", "B", "10 €", "d")]
    shuffled = store.upsert(base(spark), new.orderBy(F.desc("n")).repartition(3), order="n")
    assert sorted((r.link, r.titulo, r.preco_base, r.data_limite) for r in shuffled.collect()) == rows
    listing = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    assert sorted(map(tuple, project.overlay(listing, spark.createDataFrame([(1, "x"), (1, "y"), (2, "")], "id int, t string")).collect())) == [(1, "y"), (2, "b")]


def test_criteria_and_delivery_dates_are_filled_in(spark):
    df = align(spark.createDataFrame([(1, "a", "l1", "A 1 • A 1"), (2, "b", "l2", "B 2"), (3, "c", "l3", None)], "id long, titulo string, link string, criterio_resumo string"))
    clean, changed = store.clean_criteria(df)
    assert {r.id: r.criterio_resumo for r in clean.collect()} == {1: "A 1", 2: "B 2", 3: None} and [r.id for r in changed.collect()] == [1]
    texts = spark.createDataFrame([(3, "Preço: 100%"), (2, "nada"), (9, "Preço: 100%")], "id long, texto string")
    assert {r.id: (r.criterio_resumo, r.criterio_tipo) for r in store.refresh_criteria(clean, texts).collect()} == {1: ("A 1", None), 2: ("B 2", None), 3: ("Preço 100%", "Monofator")}
    found = spark.createDataFrame([("l1", "05-07-2026", None), ("l9", "x", "y")], "link string, data_entrega_propostas string, link_anuncio_dr string")
    assert {r.link: r.data_entrega_propostas for r in store.fill_delivery_dates(df, found).collect()} == {"l1": "05-07-2026", "l2": None, "l3": None}


def test_results_are_written_whole(spark, tmp_path):
    source.write_notices(base(spark), str(tmp_path / "out"))
    assert spark.read.schema(STORED).json(str(tmp_path / "out")).count() == 2


def test_pages_cover_the_list(spark):
    df, as_of = notices(spark, SF), F.lit(AS_OF).cast("date")
    rows = listing.selected(df, as_of).where("id < 300")
    whole = [r.id for r in rows.orderBy(F.desc_nulls_last("data_publicacao"), F.desc("id")).collect()]
    pages = [r.id for n in range(1, -(-len(whole) // 100) + 1) for r in listing.page(rows, n, 100).collect()]
    assert pages == whole
    now, past = listing.selected(df, as_of), listing.selected(df, as_of, "historico")
    assert now.count() + past.count() == df.count()


def test_sources(spark, tmp_path):
    item = {"id": "7", "contractDesignation": " Projeto ", "contractingEntities": [{"description": "A"}, {"description": "A"}], "drPublicationDate": "2026-07-03", "cpvs": ["71200000", {"code": "71400000-2", "name": " Paisagismo "}, {"id": 5}, "71200000"]}
    (tmp_path / "page.json").write_text(json.dumps({"items": [item]}))
    row = project.normalised(source.read_notices(spark, str(tmp_path / "page.json"))).first()
    assert (row.titulo, row.entidade, row.data, row.cpv) == ("Projeto", "A", "03-07-2026", "71200000; 71400000-2, Paisagismo; 5")
    bodies = spark.createDataFrame([('({"item": {"a": 1}})',), ('{"items": [{"a": 2}]}',), ("[1]",), ("x",)], "b string")
    out = bodies.select(F.to_json(source.unwrapped(source.cleaned_payload(F.col("b")))).alias("v"))
    assert [r.v for r in out.collect()] == ['{"a":1}', '{"a":2}', None, None]
    kept = STORED.fromDDL("titulo string, link string")
    (tmp_path / "good.json").write_text('[{"titulo": "a", "link": "l"}, {"titulo": "b", "link": "m"}]')
    (tmp_path / "bad.json").write_text('[{"titulo": "a", ')
    assert [len(source.read_checkpoint(spark, str(tmp_path / n), kept).collect()) for n in ("good.json", "bad.json", "missing.json")] == [2, 0, 0]
    with pytest.raises(Exception):
        source.read_checkpoint(spark, str(tmp_path / "bad.json"), kept, strict=True).collect()


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    out = ingest_distinct(spark, stream, ["user_id", "event_type"], str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(out.collect()) == sorted(events.select("user_id", "event_type").distinct().collect())
