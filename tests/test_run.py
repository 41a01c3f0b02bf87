"""Truth tables of what the daily run, the classifier and the dashboard read, on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from noticemill import lexicon as L
from noticemill.functions import text as T
from noticemill.functions.classify import analyse, relevant, state_label
from noticemill.operators import filters, project
from noticemill.plans import listing, pipeline
from noticemill.schema import align
from noticemill.sources import notices as source

RAW = source.RAW


def analysed(spark, rows):
    df = spark.createDataFrame(rows, "titulo string, texto string, cpvs array<string>, kinds array<string>")
    return [r.a for r in df.select(analyse(F.col("titulo"), F.col("texto"), F.col("cpvs"), F.col("kinds")).alias("a")).collect()]


SERVICES = ["Aquisição de Serviços"]
CASES = [
    # title, text, codes, kinds, relevant
    ("Serviços", "Descrição: elaboração de projeto\nde   arquitetura", ["71200000-0"], SERVICES, True),
    ("Serviços", None, ["71200000-0"], SERVICES, False),
    ("Projeto de arquitetura", "Tipo: fiscalização da obra", [], SERVICES, False),
    ("Projeto de arquitetura", "inclui arquitetura de sistemas", [], SERVICES, False),
    ("Projeto de arquitetura", "rede de saneamento", [], SERVICES, True),
    ("Elaboração de projeto", "rede de saneamento", ["71200000-0"], SERVICES, False),
    ("Elaboração de projeto", None, ["71200000-0"], SERVICES, True),
    ("Elaboração de projeto", None, ["71400000-2"], SERVICES, False),
    ("Elaboração", "de projeto", ["71210000"], SERVICES, True),  # a phrase across title and text
    ("Projeto de arquitetura", None, [], ["Empreitadas de obras públicas"], False),
    ("Projeto de arquitetura", None, [], ["Empreitadas de obras públicas", None, *SERVICES], True),
    ("Projeto de arquitetura", None, None, None, False),
    (None, "serviços de ARQUITETURA", [], ["prestação de serviços"], True),
]


def test_classifier_reads_title_and_text(spark):
    for case, got in zip(CASES, analysed(spark, [c[:4] for c in CASES])):
        assert got.relevante == case[4], case


def test_relevance_alone_is_that_of_the_analysis(spark):
    rnd = random.Random(3)
    words = [*L.EXPLICIT[::9], *L.DESIGN_ACTION[::7], *L.COORDINATION[::4], *L.EXCLUSION[::6], *L.SUPERVISION[::6], *L.ENGINEERING[::8], "obra", None]
    kinds = [None, [], SERVICES, ["Empreitadas de obras públicas"], [None, *SERVICES]]
    rows = [c[:4] for c in CASES] + [(rnd.choice(words), " ".join(filter(None, rnd.choices(words, k=rnd.randint(0, 2)))), rnd.choice([None, ["71200000-0"], ["45000000-7"]]), rnd.choice(kinds)) for _ in range(400)]
    df = spark.createDataFrame(rows, "titulo string, texto string, cpvs array<string>, kinds array<string>")
    columns = [F.col(c) for c in df.columns]
    got = df.select(analyse(*columns)["relevante"].alias("a"), relevant(*columns).alias("b")).collect()
    assert all(r.a is r.b for r in got) and {r.b for r in got} == {True, False}


def test_a_record_is_made_once(spark):
    as_of, none = F.lit("2026-07-23").cast("date"), spark.createDataFrame([], "link_anuncio_dr string, texto string")
    rows = raw(spark, LISTED)
    out = pipeline.collect(rows, raw(spark, DETAILS), none, pipeline.record_layout(rows).limit(0), as_of)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Descrição: ") == 1  # not for the check again


def test_dashboard_searches_what_it_shows(spark):
    rows = [(1, "Escola", "Câmara", "Lisboa", "Sintra", "1.250,50 €", "cpv único", "Concurso"), (2, "Museu", None, "", None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, titulo string, entidade string, distrito string, municipio string, preco_base string, cpv string, tipo_procedimento string")
    hit = lambda term: [r.id for r in df.where(filters.dashboard_search(term, *filters.SEARCHED)).collect()]
    for term, ids in {"lisboa": [1], "SINTRA": [1], ",50": [1], "câmara lisboa": [1], "lisboa sintra 1.250": [1], "único": [], "concurso": [], " museu ": [2], "": [1, 2], "escola  ": [1]}.items():
        assert hit(term) == ids, term
    chosen = lambda **k: [r.id for r in df.withColumn("estado", F.lit("aberto")).where(filters.dashboard(F.current_date(), F.current_timestamp(), F.lit(None).cast("string"), **k)).collect()]
    assert chosen(district=(F.col("distrito"), "Todos os distritos")) == [1, 2] and chosen(district=(F.col("distrito"), "Lisboa")) == [1]
    assert chosen(procedures=["CONCURSÓ"]) == [1]


def raw(spark, rows):
    names = [c.strip().split()[0] for c in RAW.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RAW)


LISTED = [
    {"id": "1", "contractDesignation": "Projeto de arquitetura", "drPublicationDate": "2026-07-20", "contractType": "Aquisição de serviços", "reference": "https://g/1.pdf"},
    {"id": "2", "contractDesignation": "Fornecimento", "drPublicationDate": "2026-07-20"},  # the prefilter finds nothing
    {"id": "3", "contractDesignation": "Projeto de arquitetura", "drPublicationDate": "2026-07-20"},  # its detail has another title
    {"id": "4", "contractDesignation": "Projeto de arquitetura", "drPublicationDate": "2026-07-01"},  # too old
    {"id": "5", "contractDesignation": "Projeto de arquitetura", "drPublicationDate": "logo", "contractType": "Prestação de serviços"},  # undated
    {"id": " ", "contractDesignation": "Projeto de arquitetura", "drPublicationDate": "2026-07-20"},
    {"id": None, "contractDesignation": "Projeto de arquitetura", "drPublicationDate": "2026-07-20"},
    {"id": "6", "contractDesignation": "Projeto de arquitetura", "drPublicationDate": "2026-07-20", "contractType": "Aquisição de serviços"},  # seen before
    {"id": "7", "contractDesignation": "Projeto de arquitetura", "drPublicationDate": "2026-07-21", "contractType": "Aquisição de serviços"},
    {"id": "8", "contractDesignation": "Fornecimento de projeto de arquitetura", "drPublicationDate": "2026-07-21", "cpvs": ["71200000-0"]},  # no services contract
]
DETAILS = [
    {"id": "3", "contractDesignation": "Mobiliário"},
    {"id": "7", "contractDesignation": "Projeto de arquitetura", "basePrice": "10 €", "description": "x"},
    {"id": "1", "proposalDeadline": "2026-08-01"},
    {"id": "9", "contractDesignation": "nobody asks"},
]


@pytest.fixture(scope="module")
def ran(spark):
    as_of = F.lit("2026-07-23").cast("date")
    known = raw(spark, [{"id": "6", "contractDesignation": "Projeto de arquitetura antigo", "contractType": "Aquisição de serviços"}])
    link = "https://portal.example.org/detalhe/?type=anuncios&id="
    store = align(spark.createDataFrame([(4, "velho", f"{link}7", "5 €"), (9, "outro", f"{link}99", None)], "id long, titulo string, link string, preco_base string"))
    gazettes = spark.createDataFrame([("https://g/1.pdf", "Nome: Preço\nPonderação: 100%\nPrazo para apresentação das propostas: 05-08-2026 17:00")], "link_anuncio_dr string, texto string")
    return pipeline.run(raw(spark, LISTED), raw(spark, DETAILS), gazettes, pipeline.record_layout(known), store, as_of)


def test_prefilter_reads_the_raw_fields(spark, ran):
    got = {r.id for r in pipeline.candidates(raw(spark, LISTED), F.lit("2026-07-23").cast("date")).collect()}
    assert got == {"1", "3", "5", "6", "7", "8"}


def test_collected_records_pass_both_checks_and_are_new(ran):
    rows = {r.id_portal_base: r for r in ran.checkpoint.collect()}
    assert set(rows) == {"1", "5", "6", "7", "8"}
    assert rows["6"].titulo == "Projeto de arquitetura antigo"  # the checkpoint's record wins
    assert (rows["1"].data, rows["1"].data_limite, rows["1"].criterio_resumo, rows["1"].data_entrega_propostas) == ("20-07-2026", "01-08-2026", "Preço 100%", "05-08-2026 17:00")
    assert (rows["5"].data, rows["5"].criterio_resumo) == ("logo", None)
    assert "Preço base: 10 €" in rows["7"].texto and rows["8"].tipos_contrato == []


def test_store_and_counters_of_the_run(ran):
    rows = {r.link.split("=")[-1]: r for r in ran.store.collect()}
    assert set(rows) == {"7", "99", "1", "5", "6"}
    assert (rows["7"].id, rows["7"].titulo, rows["7"].preco_base, rows["99"].titulo) == (4, "Projeto de arquitetura", "10 €", "outro")
    assert sorted(rows[k].id for k in ("1", "5", "6")) == [10, 11, 12] and rows["1"].data_entrega_propostas == "05-08-2026 17:00"
    assert ran.counters.first().asDict() == {"analisados": 5, "relevantes": 4, "excluidos": 1, "novos": 3, "existentes": 1, "atualizados": 1}


def test_first_of_an_id_by_the_listings_order(spark):
    rows = raw(spark, [{"id": "1", "contractDesignation": f"Projeto de arquitetura {x}"} for x in "cab"]).withColumn("position", F.when(F.col("contractDesignation").endswith("a"), 1).otherwise(2))
    got = pipeline.candidates(rows, F.current_date(), pipeline.Config(order="position")).collect()
    assert [r.contractDesignation[-1] for r in got] == ["a"]


def test_normalised_kinds_deadlines_and_numbers(spark):
    rows = raw(spark, [{"id": "7", "contractType": "A", "contractingProcedureType": "B", "modelType": "A", "type": "C", "proposalDeadline": " 18  dias. ", "announcementNumber": " "}, {"id": "8", "proposalDeadline": "2026-08-01T10:00:00", "announcementNumber": "5/2026"}])
    a, b = project.normalised(rows).orderBy("id_portal_base").collect()
    assert (a.tipos_contrato, a.tipo_procedimento, a.data_limite, a.numero_anuncio) == (["A", "B", "C"], "A; B; C", "18 dias.", "7")
    assert (b.tipos_contrato, b.tipo_procedimento, b.data_limite, b.numero_anuncio) == ([], None, "01-08-2026", "5/2026")


def test_record_by_id(spark):
    df = align(spark.createDataFrame([(1, "a", "l")], "id long, titulo string, link string"))
    assert listing.by_id(df, 1).columns == listing.RECORD and listing.by_id(df, 2).count() == 0


def test_small_forms(spark):
    df = spark.createDataFrame([(" a, b,,c ", "aberto", None, "", "Porto"), (None, "x", "Gaia", "Porto", "E")], "p string, s string, m string, d string, e string")
    out = df.select(T.split_trimmed(F.col("p")).alias("p"), state_label(F.col("s")).alias("s"), project.location(F.col("m"), F.col("d"), F.col("e")).alias("l"), T.shortened(F.col("p"), 3).alias("t"), T.as_list(F.col("p")).alias("g")).collect()
    assert [tuple(r) for r in out] == [(["a", "b", "", "c"], "Aberto", "Porto", " a,", [" a, b,,c "]), (None, "Sem prazo", "Gaia", None, [])]
