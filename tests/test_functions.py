"""Truth tables of the scalar functions."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from noticemill.functions import classify, dates, extract, money, text
from noticemill import lexicon as L


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("out"))
    return [r.out for r in rows.orderBy("i").collect()]


def test_price_forms(spark):
    cases = {
        "1.250.000,00 €": "1250000", "1250000.00": "1250000", "1 250 000 €": "1250000", "1.250": "1250", "1.25": "1.25", "1,250": "1.25",
        "1,250,000": "1250000", "1.250.00": "1250", "1,250.75": "1250.75", "1.": "1", "-5": None, "5-": None, "€": None, "": None, "1e5": "15",
        "1.250.000": "1250000", ".": None, "75000.00 EUR": "75000",
    }
    got = column(spark, [*cases, None], money.parse_price)
    assert got == [Decimal(v) if v else None for v in cases.values()] + [None]


def test_price_output_and_changes(spark):
    assert column(spark, [Decimal("1234.565"), None], lambda c: money.format_eur(c, "Não disponível"), "decimal(10,3)") == ["1.234,56 €", "Não disponível"]
    pairs = spark.createDataFrame([(4, 3), (0, 3), (3, 0), (0, 0), (3, 3)], "a int, b int")
    assert [r[0] for r in pairs.select(money.change_label(F.col("a"), F.col("b"))).collect()] == ["+33.3%", "-100.0%", "Novo", "0%", "0.0%"]


def test_date_profiles(spark):
    day = dt.date(2026, 7, 3)
    same = ["03-07-2026", "3-7-2026", "03/07/2026", "2026-07-03", "2026-7-3", "2026-07-03T10:11:12", "2026-07-03 10:11:12", " 3-7-2026 "]
    assert column(spark, same, dates.parse_date) == [day] * len(same)
    assert column(spark, ["31-02-2026", "03-07-26", "3-7/2026", "sem data", "", None], dates.parse_date) == [None] * 6
    more = ["2026-07-03T10:11:12.123", "2026-07-03T10:11:12Z"]
    assert column(spark, more, dates.parse_date) == [None, None]
    for profile in ("store", "collector", "monthly"):
        assert column(spark, more, lambda c: dates.parse_date(c, profile)) == [day, day]
    assert column(spark, ["em 3/7/2026, às 17h"], lambda c: dates.parse_date(c, "collector")) == [day]
    assert column(spark, ["publicado 2026-07-03 hoje"], lambda c: dates.parse_date(c, "monthly")) == [day]
    assert column(spark, ["3-7-2026 10:11:12"], lambda c: dates.parse_date(c, "store")) == [day]


def test_deadlines_and_states(spark):
    published = F.lit("2026-07-01").cast("date")
    cases = {"18 dias.": dt.date(2026, 7, 19), "31 dias úteis": dt.date(2026, 8, 1), "0 dias": None, "15-08-2026": dt.date(2026, 8, 15), "23-07-2026 17:00": dt.date(2026, 7, 23), "n/d": None, " ": None}
    assert column(spark, [*cases, None], lambda c: dates.deadline(published, c)) == [*cases.values(), None]
    today = F.lit("2026-07-19").cast("date")
    ends = ["2026-07-19", "2026-07-18", None]
    assert column(spark, ends, lambda c: dates.state(c.cast("date"), today)) == ["aberto", "encerrado", "sem_prazo"]


def test_days_left_and_freshness(spark):
    today = F.lit("2026-07-01").cast("date")
    assert column(spark, ["05-07-2026 17:00", "05-07-2026", "30-06-2026 10:00", "x"], lambda c: dates.days_left(dates.delivery_time(c, "23:59"), today)) == [5, 5, 0, None]
    assert column(spark, ["2026-07-02", "2026-06-30", "2026-06-24", "2026-06-23"], lambda c: dates.freshness(c.cast("date"), today)) == ["Hoje", "Ontem", "7 dias", None]
    assert column(spark, ["2026-03-09"], lambda c: dates.month_name(c.cast("date"))) == ["Março"]


def test_dashboard_dates_begin_the_text(spark):
    texts = ["2026-03-09T23:00", "9.3.2026 às 10h", "9/3/2026", "09-03-2026", "2026-02-30", "32.13.2026", "sem", None]
    assert column(spark, texts, lambda c: dates.dashboard_date(c).cast("string")) == ["2026-03-09"] * 4 + ["2026-03-02", "2027-02-01", None, None]


def test_texts_are_read_once(spark):
    """However many phrases are looked for, the folding of the text stands once in the plan."""
    plan = spark.createDataFrame([("x", "y")], "t string, k string").select(classify.analyse(F.col("t"), F.lit(""), F.array(F.lit("1")), F.array("k")).alias("a")).select("a.relevante", "a.motivos", "a.exclusoes")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("translate(") <= 3  # the text, and the kinds for services and works


def test_folding_and_forms(spark):
    assert column(spark, ["Conceção N.º 1 ½ ﬁm"], lambda c: text.fold(c)) == ["Concecao N.º 1 ½ ﬁm"]
    assert column(spark, ["  Conceção, N.º 1 "], text.search_form) == ["concecao n o 1"]
    assert column(spark, ["  Arquitetura, Engenharia\n e X ", None], text.classify_form) == ["arquitetura, engenharia e x", ""]
    assert column(spark, ["a • b • a •  ", " ", None], text.dedup_bullets) == ["a • b", " ", None]
    assert column(spark, [" x ", " ", None], text.blank_to_null) == ["x", None, None]


def test_award_criteria(spark):
    doc = "Nome: Qualidade\nPonderação: 30%\n\nNOME:  Preço\n\nponderação:  70%\nNome: Qualidade\nPonderação: 30%"
    out = column(spark, [doc, "Preço: 100%", "nada", None], lambda c: extract.criteria_text(extract.award_criteria(c)))
    assert out == ["Qualidade 30% • Preço 70%", "Preço 100%", None, None]
    assert column(spark, [doc, "Preço: 100%", "x"], lambda c: extract.criteria_type(extract.award_criteria(c))) == ["Multifator", "Monofator", None]


def test_delivery_date_and_ids(spark):
    docs = ["Prazo para apresentação das propostas: 05-07-2026 17:00", "DATA LIMITE PARA APRESENTAÇÃO DAS PROPOSTAS - 06-07-2026", "sem"]
    assert column(spark, docs, extract.delivery_date) == ["05-07-2026 17:00", "06-07-2026", None]
    assert column(spark, ["https://x.pt/d/?type=anuncios&id=451620", "https://x.pt/", " ", "não é url", None], extract.portal_id) == ["451620", None, None, None, None]
    assert column(spark, ["71200000-0; 12345678", "x71200000"], lambda c: F.array_join(extract.cpv_codes(c), ",")) == ["71200000,12345678", ""]


def analysed(spark, title, cpvs, kinds):
    out = classify.analyse(F.lit(title), F.lit(None).cast("string"), F.array(*map(F.lit, cpvs)), F.array(*map(F.lit, kinds)))
    return spark.range(1).select(out.alias("a")).first()["a"]


def test_classification_branches(spark):
    services, works = "Aquisição de serviços", "Empreitadas de obras públicas"
    a = analysed(spark, "Projeto de Arquitetura da escola", [], [services])
    assert a.relevante and a.correspondencias == ["projeto de arquitetura"] and a.motivos == [L.REASONS["service"], L.REASONS["explicit"]]
    assert not analysed(spark, "Projeto de arquitetura da escola", [], [works]).relevante
    assert analysed(spark, "Elaboração do projeto do centro", ["71200000-0"], [services]).relevante
    assert not analysed(spark, "Elaboração do projeto do centro", ["71400000-2"], [services]).relevante
    blocked = analysed(spark, "Serviços de arquitetura e fiscalização da obra", [], [services])
    assert not blocked.relevante and blocked.exclusoes == ["fiscalizacao da obra"]
    isolated = analysed(spark, "Elaboração do projeto da estrada", ["71200000-0"], [services])
    assert not isolated.relevante and isolated.exclusoes == ["estrada"] and L.REASONS["engineering"] in isolated.motivos


def test_categories_and_services(spark):
    assert column(spark, ["Escola da rua", "Praça", "Praca", "Museu", None], classify.category) == ["Escolas", "Espaço público", "Outros", "Património", "Outros"]
    assert column(spark, ["Revisão do projeto", "Coordenação", "Concurso de conceção", "Projeto", "x"], lambda c: classify.service(c, F.lit(None).cast("string"))) == [
        "Revisão / Análise de projeto", "Fiscalização / Coordenação", "Concurso de conceção", "Elaboração de projeto", None,
    ]


def test_criteria_section_and_factors(spark):
    doc = "9 - Outros\n10 - Critérios de adjudicação\nMultifator\nNome: Qualidade técnica\nPonderação: 60,0%\nPreço 40%\nPrazo\nPeso: 5 %\n 11 - Garantia 5%\nfim"
    section = "10 - Critérios de adjudicação\nMultifator\nNome: Qualidade técnica\nPonderação: 60,0%\nPreço 40%\nPrazo\nPeso: 5 %"
    assert column(spark, [doc, "nada", None], extract.criteria_section) == [section, "", ""]
    as_text = lambda c: F.array_join(F.transform(extract.factors(c), lambda x: F.concat_ws("=", x["nome"], x["peso"])), "|")
    assert column(spark, [section, ""], as_text) == ["Ponderação=60%|Preço=40%|Prazo=5%", ""]
    assert column(spark, ["a 12,5 %", "7.0%", "x", None], extract.percentage) == ["12.5%", "7%", None, None]


def test_forms_of_white_space_are_those_of_the_regular_expressions(spark):
    rnd = random.Random(5)
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()] + list("\x1c\x1f᠎​⁠﻿")
    values = [None, "", *spaces, *(f"{s}a{s}" for s in spaces), *("".join(rnd.choices([*spaces, "a", "É", "́", "-", "İ"], k=rnd.randint(1, 12))) for _ in range(2000))]
    stripped = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    collapsed = lambda c: stripped(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    searched = lambda c: F.trim(F.regexp_replace(text.fold(F.lower(collapsed(c)), compat=True), "[^a-z0-9]+", " "))
    for f, want in ((text.pstrip, stripped), (text.collapse, collapsed), (text.search_form, searched)):
        assert column(spark, values, f) == column(spark, values, want)
    plan = spark.createDataFrame([("a",)], "v string").select(text.pstrip(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan  # no search at each character
