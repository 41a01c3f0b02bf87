"""Registry of the queries over notices and the other driver tables, each with its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify, dates, extract, money, text
from . import lexicon as L
from .lexicon import BUILDING_WORDS, COMPETITION_WORDS, PROJECT_WORDS, SERVICE_WORDS, STRONG_WORDS
from .operators import aggregate, filters, project, store
from .operators.numbering import numbered
from .plans import listing, pipeline, report
from .sources import notices as source
from .sources.fixtures import AS_OF, DUCK_DETAILS, DUCK_NOTICES, RAW_DETAIL_SQL, RAW_SQL, details, gazettes, notices, raw_details, raw_notices
from .stored import shared_folder
from .streaming.ingest import ingest_distinct

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _as_of():
    return F.lit(AS_OF).cast("date")


# DuckDB pieces ---------------------------------------------------------------------------------------------------

_DAY = f"DATE '{AS_OF}'"


def _d_date(c: str, more: tuple[str, ...] = ()) -> str:
    formats = ["%d-%m-%Y", "%d/%m/%Y", "%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", *more]
    return f"CAST(try_strptime(trim({c}), [{', '.join(repr(f) for f in formats)}]) AS DATE)"


_D_PUB = _d_date("data")
_D_LIMIT = _d_date("data_limite", ("%d-%m-%Y %H:%M",))
_D_DAYS = "TRY_CAST(regexp_extract(data_limite, '([0-9]+)', 1) AS INTEGER)"
_D_END = f"CASE WHEN pub IS NULL OR trim(coalesce(data_limite, '')) = '' THEN NULL WHEN {_D_LIMIT} IS NOT NULL THEN {_D_LIMIT} WHEN {_D_DAYS} > 0 THEN pub + {_D_DAYS} END"
_S = r"regexp_replace(preco_base, '[^0-9,.\-]', '', 'g')"
_D_PLAIN = (
    "CASE WHEN contains(s, ',') AND contains(s, '.') THEN CASE WHEN strpos(reverse(s), ',') < strpos(reverse(s), '.') THEN replace(replace(s, '.', ''), ',', '.') ELSE replace(s, ',', '') END "
    "WHEN len(s) - len(replace(s, ',', '')) = 1 THEN replace(s, ',', '.') WHEN contains(s, ',') THEN replace(s, ',', '') "
    "WHEN len(s) - len(replace(s, '.', '')) > 1 THEN CASE WHEN strpos(reverse(s), '.') - 1 BETWEEN 1 AND 2 THEN concat(replace(left(s, len(s) - strpos(reverse(s), '.')), '.', ''), '.', right(s, strpos(reverse(s), '.') - 1)) ELSE replace(s, '.', '') END "
    "WHEN contains(s, '.') AND strpos(reverse(s), '.') = 4 THEN replace(s, '.', '') ELSE s END"
)
_D_PRICE = f"(SELECT CASE WHEN regexp_full_match(p, '[0-9]*[.]?[0-9]*') AND regexp_matches(p, '[0-9]') THEN CAST(p AS DECIMAL(28,6)) END FROM (SELECT {_D_PLAIN} AS p FROM (SELECT {_S} AS s)))"
_WITH = f"WITH {DUCK_NOTICES}, {DUCK_DETAILS}, n0 AS (SELECT *, {_D_PUB} AS pub, {_D_PRICE} AS preco FROM notices), n1 AS (SELECT *, {_D_END} AS fim FROM n0), " + (
    f"t AS (SELECT *, CASE WHEN fim IS NULL THEN 'sem_prazo' WHEN fim >= {_DAY} THEN 'aberto' ELSE 'encerrado' END AS estado FROM n1) "
)
_PAGE_COLUMNS = "id, titulo, CASE WHEN trim(coalesce(entidade, '')) = '' THEN 'Entidade não indicada' ELSE trim(entidade) END AS entidade, link, pub AS data_publicacao, fim AS data_fim, estado, preco_base, cpv, tipo_procedimento"


def _fold(c: str) -> str:
    return f"strip_accents(lower({c}))"


def _words(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words)) + "]"


def _hits(c: str, words: list[str]) -> str:
    return f"list_filter({_words(words)}, lambda w: contains({c}, w))"


def _case(c: str, table: dict[str, list[str]], other: str | None) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'contains({c}, {_q(w)})' for w in words)} THEN {_q(k)}" for k, words in table.items())
    return f"CASE {whens} ELSE {_q(other) if other else 'NULL'} END"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL; {T} stands for the common tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.replace("{T}", _WITH)
        return f

    return add


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.typed(notices(spark, sf_dir), _as_of())


# Dates, prices -----------------------------------------------------------------------------------------------------


@query("{T} SELECT id, pub AS listing, pub AS store, pub AS collector, pub AS monthly, CASE WHEN pub IS NULL THEN regexp_replace(trim(data), '\\s+', ' ', 'g') ELSE strftime(pub, '%d-%m-%Y') END AS shown FROM t")
def parse_publication_date(spark, sf_dir):
    c = F.col("data")
    return notices(spark, sf_dir).select("id", *(dates.parse_date(c, p).alias(p) for p in ("listing", "store", "collector", "monthly")), dates.formatted(c).alias("shown"))


@query("{T} SELECT id, fim AS data_fim, estado FROM t")
def deadline_state(spark, sf_dir):
    return _typed(spark, sf_dir).select("id", "data_fim", "estado")


@query("{T} SELECT id, CAST(preco AS VARCHAR) AS preco FROM t")
def price_parse(spark, sf_dir):
    return _typed(spark, sf_dir).select("id", F.col("preco").cast("string").alias("preco"))


@query("{T} SELECT count(preco) AS n_precos, CAST(CAST(sum(preco) AS DECIMAL(38,6)) AS VARCHAR) AS soma, CAST(round(CAST(sum(preco) AS DOUBLE) / count(preco), 2) AS DOUBLE) AS media FROM t")
def price_stats(spark, sf_dir):
    out = aggregate.price_stats(_typed(spark, sf_dir))
    return out.select("n_precos", F.col("soma").cast("decimal(38,6)").cast("string").alias("soma"), F.round(F.col("media").cast("double"), 2).alias("media"))


@query("{T} SELECT id, coalesce(replace(replace(replace(format('{:,.2f}', CAST(preco AS DOUBLE)), ',', '#'), '.', ','), '#', '.') || ' €', 'Não disponível') AS preco FROM t")
def price_display(spark, sf_dir):
    return _typed(spark, sf_dir).select("id", money.format_eur(F.col("preco"), "Não disponível").alias("preco"))


# Listings ------------------------------------------------------------------------------------------------------------


def _page(sql_where: str, number: int = 1, size: int = 20) -> str:
    return f"{{T}} SELECT {_PAGE_COLUMNS} FROM t WHERE {sql_where} ORDER BY pub DESC NULLS LAST, id DESC LIMIT {size} OFFSET {(number - 1) * size}"


@query(_page("estado <> 'encerrado'"))
def listing_current_page1(spark, sf_dir):
    return listing.listing(notices(spark, sf_dir), _as_of())[0]


@query(_page("estado = 'encerrado'", 2))
def listing_history_page2(spark, sf_dir):
    return listing.listing(notices(spark, sf_dir), _as_of(), 2, period="historico")[0]


@query(_page("estado <> 'encerrado' AND (contains(lower(titulo), 'museu') OR contains(lower(coalesce(entidade, '')), 'museu') OR contains(lower(cpv), 'museu'))", 1, 100))
def listing_search_term(spark, sf_dir):
    return listing.listing(notices(spark, sf_dir), _as_of(), 1, 100, search=" MUSEU ")[0]


@query(_page("estado <> 'encerrado' AND contains(lower(coalesce(entidade, '')), 'ation_1')", 1, 100))
def listing_entity_filter(spark, sf_dir):
    return listing.listing(notices(spark, sf_dir), _as_of(), 1, 100, entity=" Ation_1 ")[0]


@query(_page("estado = 'aberto' AND relevante = 1 AND contains(lower(coalesce(tipo_procedimento, '')), 'prévia')", 1, 100))
def listing_procedure_filter(spark, sf_dir):
    return listing.listing(notices(spark, sf_dir), _as_of(), 1, 100, procedure="prévia", only_relevant=True, state="aberto")[0]


@query("{T} SELECT count(*) AS total FROM t WHERE estado <> 'encerrado'")
def listing_total(spark, sf_dir):
    return listing.listing(notices(spark, sf_dir), _as_of())[1]


@query("{T} SELECT estado, count(*) AS total FROM t GROUP BY estado")
def listing_total_by_state(spark, sf_dir):
    return _typed(spark, sf_dir).groupBy("estado").agg(F.count("*").alias("total"))


@query("{T} SELECT id, titulo, entidade, link, data, relevante, data_limite, preco_base, cpv, tipo_procedimento, estado FROM t WHERE id = 7")
def notice_by_id(spark, sf_dir):
    return listing.by_id(_typed(spark, sf_dir), 7, "estado")


@query("{T} SELECT id, entidade FROM t WHERE lower(titulo) LIKE '%p_oj%cto%' OR lower(coalesce(entidade, '')) LIKE '%p_oj%cto%' OR lower(titulo) LIKE '%esc_la%'")
def like_search(spark, sf_dir):
    df = notices(spark, sf_dir)
    return df.where(filters.like_text("P_oj%cto", "titulo", "entidade") | filters.like_text("ESC_la", "titulo")).select("id", "entidade")


@query("{T} SELECT id, year(pub) AS ano FROM t WHERE year(pub) < 2001")
def history_by_year(spark, sf_dir):
    df = _typed(spark, sf_dir)
    return df.where(filters.in_period_by_year(F.col("data_publicacao"), _as_of(), "historico")).select("id", F.year("data_publicacao").cast("long").alias("ano"))


@query("{T} SELECT id, coalesce(pub, DATE '1970-01-01') AS chave FROM t")
def oldest_first(spark, sf_dir):
    df = listing.sorted_by_date(_typed(spark, sf_dir), newest=False)
    return df.select("id", F.coalesce("data_publicacao", F.lit("1970-01-01").cast("date")).alias("chave"))


@query("{T} SELECT id, row_number() OVER (ORDER BY id DESC) AS posicao FROM t")
def numbered_rows(spark, sf_dir):
    return numbered(notices(spark, sf_dir).select("id"), F.desc("id"))


def _places(df: DataFrame, *order) -> DataFrame:
    return numbered(df, *order, name="lugar").select("id", "lugar")


@query("{T} SELECT id, row_number() OVER (ORDER BY pub DESC NULLS LAST, id DESC) AS lugar FROM t WHERE estado <> 'encerrado'")
def listing_places(spark, sf_dir):
    """Every current notice's place in the listing."""
    return _places(listing.selected(notices(spark, sf_dir), _as_of()).select("id", "data_publicacao"), *listing.newest_first())


@query("{T} SELECT id, row_number() OVER (ORDER BY pub, titulo, id) AS lugar FROM t WHERE pub >= DATE '2001-06-01' AND pub < DATE '2001-07-01'")
def period_places(spark, sf_dir):
    """Every notice's place in the period's list; ties by id, so that places are the same in each run."""
    rows = report.monthly_summary(_typed(spark, sf_dir), _as_of()).select("id", "data_publicacao", "titulo")
    return _places(rows, *report.oldest_first(), F.col("id"))


@query("{T} SELECT id, row_number() OVER (ORDER BY coalesce(pub, DATE '1970-01-01'), id) AS lugar FROM t")
def oldest_first_places(spark, sf_dir):
    return _places(_typed(spark, sf_dir).select("id", "data_publicacao"), *listing.by_date(newest=False))


# Statistics ------------------------------------------------------------------------------------------------------------


@query("{T} SELECT count(*) AS total_concursos, count(*) FILTER (WHERE relevante = 1) AS concursos_relevantes, count(*) FILTER (WHERE trim(preco_base) <> '') AS com_preco, count(*) FILTER (WHERE trim(data_limite) <> '') AS com_prazo FROM t")
def statistics_summary(spark, sf_dir):
    return aggregate.statistics(notices(spark, sf_dir))


@query("{T} SELECT entidade, count(*) AS total FROM t WHERE trim(entidade) <> '' GROUP BY entidade ORDER BY total DESC, entidade LIMIT 10")
def top10_entities(spark, sf_dir):
    return aggregate.top_values(notices(spark, sf_dir), "entidade", 10)


@query("{T} SELECT CASE WHEN trim(coalesce(entidade, '')) = '' THEN 'Entidade não indicada' ELSE trim(entidade) END AS entidade, count(*) AS total, min(id) AS primeiro FROM t GROUP BY 1")
def top_entities_first_seen(spark, sf_dir):
    return aggregate.counts_first_seen(notices(spark, sf_dir), "entidade", "Entidade não indicada")


@query("{T} SELECT coalesce(tipo_procedimento, 'Não indicado') AS tipo_procedimento, count(*) AS total, min(id) AS primeiro FROM t GROUP BY 1")
def procedure_counts(spark, sf_dir):
    return aggregate.counts_first_seen(notices(spark, sf_dir), "tipo_procedimento", "Não indicado")


@query("{T}, e AS (SELECT entidade, count(*) AS total FROM t WHERE trim(entidade) <> '' GROUP BY entidade ORDER BY total DESC, entidade LIMIT 5) SELECT entidade, total, greatest(8, CAST(round_even(total * 100 / (SELECT max(total) FROM e), 0) AS INTEGER)) AS largura FROM e")
def entity_bars(spark, sf_dir):
    return aggregate.share_of_most(aggregate.top_values(notices(spark, sf_dir), "entidade", 5))


@query("{T} SELECT count(*) FILTER (WHERE preco_base <> '') AS com_preco, count(*) FILTER (WHERE data_limite <> '') AS com_prazo FROM t")
def presence_counts(spark, sf_dir):
    return aggregate.presence(notices(spark, sf_dir))


@query("{T} SELECT id, pub AS data_publicacao, titulo FROM t WHERE pub >= DATE '2001-06-01' AND pub < DATE '2001-07-01'")
def period_list(spark, sf_dir):
    return report.monthly_summary(_typed(spark, sf_dir), _as_of()).select("id", "data_publicacao", "titulo")


@query(
    "{T}, a AS (SELECT count(*) FILTER (WHERE pub >= DATE '2001-06-01' AND pub < DATE '2001-07-01') AS atual, count(*) FILTER (WHERE pub >= DATE '2001-05-01' AND pub < DATE '2001-06-01') AS anterior FROM t) "
    "SELECT 'Junho' AS mes, atual, anterior, round((atual - anterior) * 100.0 / nullif(anterior, 0), 6) AS variacao FROM a"
)
def month_comparison(spark, sf_dir):
    out = report.month_comparison(_typed(spark, sf_dir), _as_of(), 1)
    return out.select("mes", "atual", "anterior", F.round("variacao", 6).alias("variacao"))


_MONTHLY = "m AS (SELECT CAST(date_trunc('month', pub) AS DATE) AS mes, count(*) AS total, count(DISTINCT nullif(trim(entidade), '')) AS entidades, count(preco) AS com_preco, CAST(CAST(sum(preco) AS DECIMAL(38,6)) AS VARCHAR) AS valor_total, count(*) FILTER (WHERE trim(data_limite) <> '') AS com_prazo, count(*) FILTER (WHERE estado = 'aberto') AS abertos FROM t WHERE pub IS NOT NULL GROUP BY 1)"


@query("{T}, " + _MONTHLY + " SELECT * FROM m")
def monthly_measures(spark, sf_dir):
    out = aggregate.monthly(_typed(spark, sf_dir))
    return out.withColumn("valor_total", F.col("valor_total").cast("decimal(38,6)").cast("string")).withColumn("mes", F.col("mes").cast("date")).drop("valor_medio")


@query("{T}, " + _MONTHLY + " SELECT mes, total, lag(total) OVER (ORDER BY mes) AS total_anterior FROM m")
def monthly_lag(spark, sf_dir):
    out = aggregate.with_previous(aggregate.monthly(_typed(spark, sf_dir)), "total")
    return out.select(F.col("mes").cast("date").alias("mes"), "total", "total_anterior")


@query("SELECT DISTINCT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey")
def district_distinct_sorted(spark, sf_dir):
    both = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return aggregate.distinct_sorted(both, "n_name")


# Windows in time -------------------------------------------------------------------------------------------------------


@query(f"{{T}} SELECT id, pub AS data_publicacao FROM t WHERE pub BETWEEN {_DAY} - 6 AND {_DAY}")
def new_last_7_days(spark, sf_dir):
    return _typed(spark, sf_dir).where(filters.published_last_week(_as_of())).select("id", "data_publicacao")


_DELIVERY = "CASE id % 3 WHEN 0 THEN TIMESTAMP '2001-07-05 17:00:00' WHEN 1 THEN TIMESTAMP '2001-07-09 00:00:00' END"


def _with_delivery(spark, sf_dir):
    df = _typed(spark, sf_dir).withColumn("entrega", extract.delivery_date(F.col("texto")))
    return df.withColumn("entrega_ts", dates.delivery_time(F.col("entrega")))


@query(f"{{T}} SELECT id FROM t WHERE CAST({_DELIVERY} AS DATE) BETWEEN {_DAY} AND {_DAY} + 7")
def ending_next_7_days(spark, sf_dir):
    return _with_delivery(spark, sf_dir).where(filters.ending_within_week(_as_of(), F.col("entrega_ts"))).select("id")


@query("{T} SELECT id, CASE id % 3 WHEN 0 THEN 5 WHEN 1 THEN 9 END AS dias FROM t")
def days_remaining(spark, sf_dir):
    df = _with_delivery(spark, sf_dir)
    until = dates.delivery_time(F.col("entrega"), "23:59")
    return df.select("id", dates.days_left(until, _as_of()).alias("dias"))


@query(f"{{T}} SELECT id, CASE WHEN {_DAY} - pub <= 0 THEN 'Hoje' WHEN {_DAY} - pub = 1 THEN 'Ontem' WHEN {_DAY} - pub <= 7 THEN concat({_DAY} - pub, ' dias') END AS selo FROM t")
def freshness_badge(spark, sf_dir):
    return _typed(spark, sf_dir).select("id", dates.freshness(F.col("data_publicacao"), _as_of()).alias("selo"))


@query(f"{{T}} SELECT count(*) AS todos, count(*) FILTER (WHERE estado = 'aberto') AS ativos, count(*) FILTER (WHERE pub BETWEEN {_DAY} - 6 AND {_DAY}) AS novos, count(*) FILTER (WHERE CAST({_DELIVERY} AS DATE) BETWEEN {_DAY} AND {_DAY} + 7) AS terminam, count(DISTINCT nullif(trim(entidade), '')) AS entidades FROM t")
def dashboard_counts(spark, sf_dir):
    return listing.dashboard_counts(_with_delivery(spark, sf_dir), _as_of(), F.col("entrega_ts"))


# Classification ----------------------------------------------------------------------------------------------------------


@query("{T} SELECT id, " + _case("lower(titulo)", L.CATEGORIES, L.OTHER_CATEGORY) + " AS categoria, " + _case("lower(titulo)", L.BADGES, L.OTHER_BADGE) + " AS selo FROM t")
def category_of_title(spark, sf_dir):
    return notices(spark, sf_dir).select("id", classify.category(F.col("titulo")).alias("categoria"), classify.badge(F.col("titulo")).alias("selo"))


@query("{T} SELECT id, " + _case(_fold("concat_ws(' ', titulo, tipo_procedimento)"), L.SERVICES, None) + " AS servico FROM t")
def service_of_title(spark, sf_dir):
    return notices(spark, sf_dir).select("id", classify.service(F.col("titulo"), F.col("tipo_procedimento")).alias("servico"))


_C_REST = (
    "c1 AS (SELECT *, " + ", ".join(f"{_hits('x', w)} AS {n}" for n, w in (("ex", L.EXPLICIT), ("ac", L.DESIGN_ACTION), ("co", L.COORDINATION), ("xc", L.EXCLUSION), ("su", L.SUPERVISION), ("en", L.ENGINEERING))) + ", "
    "contains(k, 'aquisicao de servicos') OR contains(k, 'prestacao de servicos') AS serv, contains(k, 'empreitada') AS empr FROM c0), "
    "c2 AS (SELECT *, cpv_712 AND (len(ac) > 0 OR len(co) > 0) AS por_cpv, len(xc) > 0 OR len(su) > 0 AS bloq, len(en) > 0 AND len(ex) = 0 AS isol FROM c1)"
)
_C = "{T}, c0 AS (SELECT id, trim(regexp_replace(" + _fold("concat_ws(' ', titulo, texto)") + ", '\\s+', ' ', 'g')) AS x, contains(coalesce(cpv, ''), '712') AS cpv_712, " + _fold("coalesce(tipo_procedimento, '')") + " AS k FROM t), " + _C_REST + " "


@query(_C + "SELECT id, serv AND (len(ex) > 0 OR por_cpv) AND NOT bloq AND NOT isol AS relevante, serv AS aquisicao_servicos, empr AS empreitada FROM c2")
def classify_relevance(spark, sf_dir):
    return pipeline.classified(notices(spark, sf_dir)).select("id", *(F.col(f"analise.{c}").alias(c) for c in ("relevante", "aquisicao_servicos", "empreitada")))


_ORDERED = "array_to_string(list_filter({0}, lambda w, i: list_position({0}, w) = i), '|')"
_REASONS = "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN {_q(L.REASONS[k])} END" for k, c in (("service", "serv"), ("explicit", "len(ex) > 0"), ("by_cpv", "por_cpv"), ("coordination", "len(co) > 0"), ("blocked", "bloq"), ("engineering", "isol"))) + ")"


@query(_C + "SELECT id, " + _ORDERED.format("(ex || ac || co)") + " AS correspondencias, " + _ORDERED.format("(xc || su || CASE WHEN isol THEN en ELSE [] END)") + " AS exclusoes, " + _REASONS + " AS motivos FROM c2")
def classify_match_lists(spark, sf_dir):
    df = pipeline.classified(notices(spark, sf_dir))
    return df.select("id", *(F.array_join(f"analise.{c}", "|").alias(c) for c in ("correspondencias", "exclusoes", "motivos")))


def _some(c: str, words: list[str]) -> str:
    return f"len({_hits(c, words)}) > 0"


_SEARCH = "trim(regexp_replace(replace(replace(strip_accents(lower({0})), 'º', 'o'), 'ª', 'a'), '[^a-z0-9]+', ' ', 'g'))"


def _worth(c: str) -> str:
    return f"({_some(c, STRONG_WORDS)} OR {_some(c, PROJECT_WORDS)} OR ({_some(c, BUILDING_WORDS)} AND {_some(c, SERVICE_WORDS)}) OR {_some(c, COMPETITION_WORDS)})"


@query("{T}, r AS (SELECT " + RAW_SQL + " FROM t), s AS (SELECT k, " + _SEARCH.format("concat_ws(' ', contractDesignation, description, contractingEntity, contractingProcedureType, contractType, modelType, type)") + " AS x FROM r) SELECT CAST(k AS VARCHAR) AS id, " + _worth("x") + " AS consultar FROM s")
def phrase_prefilter(spark, sf_dir):
    return raw_notices(notices(spark, sf_dir)).select("id", classify.worth_details(project.prefilter_text()).alias("consultar"))


@query("{T} SELECT id, " + " + ".join(f"CASE WHEN contains(lower(titulo), {_q(k)}) THEN {v} ELSE 0 END" for k, v in L.WEIGHTS.items()) + " AS pontos FROM t")
def weighted_score(spark, sf_dir):
    return notices(spark, sf_dir).select("id", classify.weighted_score(F.col("titulo")).alias("pontos"))


@query("{T} SELECT id, array_to_string(regexp_extract_all(cpv, '\\b([0-9]{8})(?:-[0-9])?\\b', 1), ',') AS codigos, array_to_string(list_transform(string_split(cpv, ';'), lambda x: trim(x)), '|') AS partes FROM t")
def cpv_codes(spark, sf_dir):
    return notices(spark, sf_dir).select("id", F.array_join(extract.cpv_codes(F.col("cpv")), ",").alias("codigos"), F.array_join(extract.cpv_list(F.col("cpv")), "|").alias("partes"))


@query("{T} SELECT id, id % 3 = 0 AS familia_712 FROM t WHERE id % 3 < 2")
def cpv_prefix_filter(spark, sf_dir):
    df = notices(spark, sf_dir).where(extract.has_cpv(F.col("cpv")))
    return df.select("id", extract.in_cpv_family(F.split("cpv", ";")).alias("familia_712"))


# Text --------------------------------------------------------------------------------------------------------------------


@query("{T} SELECT CAST(id AS VARCHAR) AS portal_id, id FROM t")
def portal_id_from_url(spark, sf_dir):
    return notices(spark, sf_dir).select(extract.portal_id(F.col("link")).alias("portal_id"), "id")


@query("SELECT page_id, nullif(regexp_extract(url, '[?&]id=([^&#]*)', 1), '') AS id, nullif(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '') AS host FROM pages")
def url_query_param(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.nullif(extract.url_parameter(F.col("url"), "id"), F.lit("")).alias("id"), F.try_parse_url("url", F.lit("HOST")).alias("host"))


@query("SELECT doc_id, md5(strip_accents(lower(text))) AS folded FROM documents")
def fold_accents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(text.fold(F.lower("text"))).alias("folded"))


@query("SELECT doc_id, md5(" + _SEARCH.format("text") + ") AS form FROM documents")
def search_normal_form(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(text.search_form(F.col("text"))).alias("form"))


_PHRASES = ["license", "the and", "por la", "password", "est un", "token", "der die"]


@query("SELECT doc_id, array_to_string(" + _hits("lower(text)", _PHRASES) + ", '|') AS frases FROM documents")
def document_phrase_hits(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.array_join(text.matches(F.lower("text"), _PHRASES), "|").alias("frases"))


@query("{T} SELECT id, 'Multifator' AS criterio_tipo, concat('Qualidade ', id % 90, '% • Preço ', 100 - id % 90, '%') AS criterio_resumo FROM t")
def award_criteria(spark, sf_dir):
    return project.enriched(notices(spark, sf_dir)).select("id", "criterio_tipo", "criterio_resumo")


@query("{T} SELECT id, CASE id % 3 WHEN 0 THEN '05-07-2001 17:00' WHEN 1 THEN '09-07-2001' END AS entrega FROM t")
def delivery_date(spark, sf_dir):
    return notices(spark, sf_dir).select("id", extract.delivery_date(F.col("texto")).alias("entrega"))


@query("{T} SELECT id, concat('A ', id % 3, ' • B', CASE WHEN id % 3 = 1 THEN '' ELSE ' • A 1' END) AS resumo FROM t")
def dedup_bullets(spark, sf_dir):
    raw = F.expr("concat(' A ', id % 3, ' • B •', ' B •  • A 1', '')")
    return notices(spark, sf_dir).select("id", text.dedup_bullets(raw).alias("resumo"))


# Joins, store ------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def dedup_keep_first(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return store.keep_first(events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


def _orders_customers(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumnRenamed("c_custkey", "k")
    return customers, spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_custkey", "k")


@query("SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 490000)")
def anti_join_new(spark, sf_dir):
    customers, orders = _orders_customers(spark, sf_dir)
    return store.not_in(customers, orders.where("o_totalprice > 490000"), "k").select("k", "c_name")


@query("SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join_existing(spark, sf_dir):
    customers, orders = _orders_customers(spark, sf_dir)
    return store.already_in(customers, orders, "k").select("k", "c_name")


@query("{T} SELECT id, estado FROM t WHERE id IN (SELECT event_id FROM events)")
def favourites_semi(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return store.already_in(_typed(spark, sf_dir), events.select(F.col("event_id").alias("id")), "id").select("id", "estado")


@query("{T} SELECT t.id, coalesce(nullif(d.titulo, ''), t.titulo) AS titulo, coalesce(nullif(d.preco_base, ''), t.preco_base) AS preco_base, coalesce(nullif(d.data_limite, ''), t.data_limite) AS data_limite FROM t LEFT JOIN details d ON t.id = d.id")
def overlay_detail(spark, sf_dir):
    df = notices(spark, sf_dir)
    return project.overlay(df, details(df)).select("id", "titulo", "preco_base", "data_limite")


@query("{T} SELECT t.id, t.link, coalesce(nullif(trim(d.titulo), ''), t.titulo) AS titulo, coalesce(nullif(trim(d.preco_base), ''), t.preco_base) AS preco_base, coalesce(nullif(trim(d.data_limite), ''), t.data_limite) AS data_limite FROM t LEFT JOIN details d ON t.link = d.link")
def upsert_coalesce(spark, sf_dir):
    df = notices(spark, sf_dir)
    return store.upsert(df, details(df)).select("id", "link", "titulo", "preco_base", "data_limite")


@query("{T}, s AS (SELECT * FROM t WHERE id % 3 <> 0) SELECT (SELECT count(*) FROM t) AS n, (SELECT count(DISTINCT link) FROM t) AS n_links, (SELECT count(*) FROM t) AS n_ids, (SELECT max(id) FROM s) + (SELECT count(*) FROM t WHERE id % 3 = 0) AS max_id")
def insert_new(spark, sf_dir):
    df = notices(spark, sf_dir)
    out = store.insert_new(df.where("id % 3 <> 0"), df)
    return out.agg(F.count("*").alias("n"), F.count_distinct("link").alias("n_links"), F.count_distinct("id").alias("n_ids"), F.max("id").alias("max_id"))


@query("{T} SELECT id, link FROM t WHERE trim(coalesce(data_limite, '')) = '' OR trim(coalesce(preco_base, '')) = '' ORDER BY id DESC LIMIT 100")
def pending_backlog(spark, sf_dir):
    return store.pending(notices(spark, sf_dir), 100).select("id", "link")


@query("{T}, p AS (SELECT * FROM t WHERE trim(coalesce(data_limite, '')) = '' OR trim(coalesce(preco_base, '')) = '') SELECT count(*) AS analisados, count(nullif(trim(d.preco_base), '')) AS com_preco, count(nullif(trim(d.data_limite), '')) AS com_prazo, count(*) FILTER (WHERE nullif(trim(d.preco_base), '') IS NULL AND nullif(trim(d.data_limite), '') IS NULL) AS sem_dados FROM p LEFT JOIN details d ON p.link = d.link")
def backfill_counters(spark, sf_dir):
    df = notices(spark, sf_dir)
    return store.backfill(df, details(df))[1]


@query(_C + ", r AS (SELECT id, serv AND (len(ex) > 0 OR por_cpv) AND NOT bloq AND NOT isol AS rel FROM c2) SELECT count(*) AS analisados, count(*) FILTER (WHERE rel) AS relevantes, count(*) FILTER (WHERE NOT rel) AS excluidos, count(*) FILTER (WHERE rel AND id % 4 <> 0) AS novos, count(*) FILTER (WHERE rel AND id % 4 = 0) AS existentes, count(*) FILTER (WHERE rel AND id % 4 = 0) AS atualizados FROM r")
def run_counters(spark, sf_dir):
    df = notices(spark, sf_dir)
    return aggregate.run_counters(pipeline.classified(df), df.where("id % 4 = 0"))


def _formatted(c: str) -> str:
    return f"coalesce(strftime({_d_date(c)}, '%d-%m-%Y'), nullif(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ''))"


def _line(label: str, c: str) -> str:
    return f"'{label}: ' || nullif(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '')"


_RAW_TITLE = "coalesce(nullif(trim(contractDesignation), ''), nullif(trim(description), ''))"
_RAW_ENTITY = "CASE WHEN k % 3 = 0 THEN concat('Câmara ', k % 5, CASE WHEN k % 2 = 0 THEN '; Junta' ELSE '' END) ELSE coalesce(nullif(trim(contractingEntity), ''), nullif(trim(entity), '')) END"
_RAW_CPV = "CASE k % 3 WHEN 0 THEN '71200000-0, Serviços de arquitetura; 45000000-7' WHEN 1 THEN '71400000-2' ELSE '' END"
_RAW_KINDS = "[coalesce(contractType, ''), coalesce(contractingProcedureType, ''), coalesce(modelType, ''), coalesce(type, '')]"
_RAW_LINES = {"Descrição": _RAW_TITLE, "Entidade": _RAW_ENTITY, "Tipo de ato": "type", "Tipo de modelo": "modelType", "Tipo de contrato": "contractType", "Tipo de procedimento": "contractingProcedureType", "CPV": _RAW_CPV, "Preço base": "basePrice", "Prazo para propostas": "proposalDeadline", "Data de publicação": "drPublicationDate", "Número do anúncio": "announcementNumber"}


def _normalised(relation: str) -> str:
    """Raw records of a relation as flat notices."""
    kinds = f"nullif(array_to_string(list_filter({_RAW_KINDS}, lambda w, i: w <> '' AND list_position({_RAW_KINDS}, w) = i), '; '), '')"
    lines = ", ".join(_line(label, c) for label, c in _RAW_LINES.items())
    return (
        f"SELECT k AS no, id AS id_portal_base, coalesce({_RAW_TITLE}, 'Sem título') AS titulo, {_RAW_ENTITY} AS entidade, concat('https://portal.example.org/detalhe/?type=anuncios&id=', id) AS link, {_formatted('drPublicationDate')} AS data, "
        f"{_formatted('proposalDeadline')} AS data_limite, nullif(trim(basePrice), '') AS preco_base, {_RAW_CPV} AS cpv, {kinds} AS tipo_procedimento, coalesce(announcementNumber, id) AS numero_anuncio, reference AS link_anuncio_dr, concat_ws(chr(10), {lines}) AS texto FROM {relation}"
    )


_PREFILTER = "contractDesignation, description, contractingEntity, contractingProcedureType, contractType, modelType, type"
_OVERLAID = ", ".join(f"coalesce(nullif(d.{c}, ''), r.{c}) AS {c}" for c in ("contractDesignation", "contractType", "basePrice", "proposalDeadline"))
_RULES = f"({_some('f', STRONG_WORDS)} OR {_some('f', PROJECT_WORDS)} OR ({_some('f', BUILDING_WORDS)} AND {_some('f', SERVICE_WORDS)}))"
_RUN = (
    f"{{T}}, r AS (SELECT {RAW_SQL}, pub FROM t), dr AS (SELECT {RAW_DETAIL_SQL} FROM notices WHERE id % 2 = 0), "
    f"worth AS (SELECT * FROM (SELECT *, {_SEARCH.format(f'concat_ws(chr(32), {_PREFILTER})')} AS form FROM r WHERE pub IS NULL OR pub >= {_DAY} - 3650) WHERE {_worth('form')} AND k % 7 <> 0), "
    f"whole AS (SELECT r.* EXCLUDE (contractDesignation, contractType, basePrice, proposalDeadline), {_OVERLAID} FROM worth r LEFT JOIN dr d ON d.k = r.k), "
    f"found AS (SELECT * FROM (SELECT *, {_SEARCH.format('texto')} AS f FROM ({_normalised('whole')})) WHERE no % 3 < 2 OR {_RULES}), "
    f"recs AS (SELECT *, false AS novo FROM ({_normalised('(SELECT * FROM r WHERE k % 7 = 0)')}) UNION ALL SELECT * EXCLUDE (f), true AS novo FROM found), "
    "c0 AS (SELECT *, trim(regexp_replace(" + _fold("concat_ws(' ', titulo, texto)") + ", '\\s+', ' ', 'g')) AS x, no % 3 = 0 AS cpv_712, " + _fold("coalesce(tipo_procedimento, '')") + " AS k FROM recs), " + _C_REST
    + ", a AS (SELECT *, coalesce(serv AND (len(ex) > 0 OR por_cpv) AND NOT bloq AND NOT isol, false) AS rel, novo AND link_anuncio_dr IS NOT NULL AS lido FROM c2), "
    "v AS (SELECT *, CASE WHEN lido THEN concat('Qualidade ', no % 90, '% • Preço ', 100 - no % 90, '%') END AS criterio_resumo, CASE WHEN lido THEN CASE no % 3 WHEN 0 THEN '05-07-2001 17:00' WHEN 1 THEN '09-07-2001' END END AS data_entrega_propostas FROM a WHERE rel) "
)
_OVER = ["titulo", "entidade", "data", "preco_base", "data_limite", "cpv", "tipo_procedimento"]
_READ = ["link_anuncio_dr", "criterio_resumo", "data_entrega_propostas"]
_RUN_STORE = (
    "SELECT t.link, " + ", ".join(f"coalesce(nullif(trim(v.{c}), ''), t.{c}) AS {c}" for c in _OVER) + ", " + ", ".join(f"v.{c}" for c in _READ) + " FROM t LEFT JOIN v ON v.link = t.link WHERE t.id % 2 = 0 "
    "UNION ALL SELECT link, " + ", ".join(f"nullif(trim({c}), '') AS {c}" for c in _OVER) + ", " + ", ".join(_READ) + " FROM v WHERE no % 2 = 1"
)


def _run(spark, sf_dir) -> pipeline.Run:
    """The whole daily run with a store that holds every other notice and a checkpoint that holds every seventh record."""
    df = notices(spark, sf_dir)
    raw = raw_notices(df)
    seen = pipeline.record_layout(raw.where("cast(id AS long) % 7 = 0"))
    return pipeline.run(raw, raw_details(df), gazettes(df), seen, df.where("id % 2 = 0"), _as_of(), pipeline.Config(days=3650))


@query(_RUN + _RUN_STORE)
def daily_run(spark, sf_dir):
    """The store after the daily run."""
    return _run(spark, sf_dir).store.select("link", *_OVER, *_READ)


@query(_RUN + "SELECT count(*) AS analisados, count(*) FILTER (WHERE rel) AS relevantes, count(*) FILTER (WHERE NOT rel) AS excluidos, count(*) FILTER (WHERE rel AND no % 2 = 1) AS novos, count(*) FILTER (WHERE rel AND no % 2 = 0) AS existentes, count(*) FILTER (WHERE rel AND no % 2 = 0) AS atualizados FROM a")
def daily_run_counters(spark, sf_dir):
    return _run(spark, sf_dir).counters


@query(_RUN + "SELECT id_portal_base, titulo, numero_anuncio, md5(texto) AS texto, novo FROM recs")
def daily_run_checkpoint(spark, sf_dir):
    """Records found so far: those of the checkpoint and the new ones that passed both checks."""
    out = _run(spark, sf_dir).checkpoint
    return out.select("id_portal_base", "titulo", "numero_anuncio", F.md5("texto").alias("texto"), (F.col("id_portal_base").cast("long") % 7 != 0).alias("novo"))


# Raw records ---------------------------------------------------------------------------------------------------------------


@query("{T}, r AS (SELECT " + RAW_SQL + " FROM t) SELECT id_portal_base, titulo, entidade, link, data, data_limite, preco_base, cpv, tipo_procedimento, numero_anuncio, link_anuncio_dr FROM (" + _normalised("r") + ")")
def raw_normalised(spark, sf_dir):
    """Raw records as flat notices: names, entities, codes as objects and texts, kinds, dates."""
    out = project.normalised(raw_notices(notices(spark, sf_dir)))
    return out.select("id_portal_base", "titulo", "entidade", "link", "data", "data_limite", "preco_base", "cpv", "tipo_procedimento", "numero_anuncio", "link_anuncio_dr")


@query("{T}, r AS (SELECT " + RAW_SQL + " FROM t) SELECT id_portal_base, texto FROM (" + _normalised("r") + ")")
def raw_full_text(spark, sf_dir):
    return project.normalised(raw_notices(notices(spark, sf_dir))).select("id_portal_base", "texto")


@query("{T} SELECT id, CASE id % 6 WHEN 0 THEN 'item' WHEN 1 THEN 'data' WHEN 2 THEN 'items' WHEN 3 THEN 'self' WHEN 4 THEN 'resultado' END AS onde FROM t")
def detail_unwrapped(spark, sf_dir):
    bodies = [('({"item": {"w": "item"}, "data": {"w": "x"}})'), ('{"item": 3, "data": {"w": "data"}}'), ('{"items": [{"w": "items"}, 1]}'), (' {"w": "self", "result": []} '), ('{"resultado": {"w": "resultado"}}'), "no JSON"]
    body = F.element_at(F.array(*map(F.lit, bodies)), (F.col("id") % 6 + 1).cast("int"))
    return notices(spark, sf_dir).select("id", F.try_variant_get(source.unwrapped(source.cleaned_payload(body)), "$.w", "string").alias("onde"))


# Dashboard -----------------------------------------------------------------------------------------------------------------

_FIELDS = "lower(concat_ws(' ', nullif(titulo, ''), nullif(entidade, ''), nullif(distrito, ''), nullif(municipio, ''), nullif(preco_base, '')))"
_CATEGORY = _case("lower(titulo)", L.CATEGORIES, L.OTHER_CATEGORY)
_SERVICE = _case(_fold("concat_ws(' ', titulo, tipo_procedimento)"), L.SERVICES, None)
_PROCEDURE = _fold("coalesce(tipo_procedimento, '')")


def _dashboard(spark, sf_dir, **chosen):
    df = _with_delivery(spark, sf_dir)
    accepted = filters.dashboard(_as_of(), F.col("entrega_ts"), classify.service(F.col("titulo"), F.col("tipo_procedimento")), **chosen)
    return df.where(accepted).select("id")


@query(f"{{T}} SELECT id FROM t WHERE contains({_FIELDS}, 'escola básica')")
def dashboard_search_hits(spark, sf_dir):
    return _dashboard(spark, sf_dir, search="Escola BÁSICA")


@query(f"{{T}} SELECT id FROM t WHERE contains({_FIELDS}, ',50 €')")
def dashboard_search_price(spark, sf_dir):
    return _dashboard(spark, sf_dir, search=" ,50 € ")


@query(f"{{T}} SELECT id FROM t WHERE contains({_FIELDS}, 'nation_1 município 1')")
def dashboard_search_place(spark, sf_dir):
    """Across the end of one field and the beginning of the next."""
    return _dashboard(spark, sf_dir, search="Nation_1 MUNICÍPIO 1")


@query(f"{{T}} SELECT id FROM t WHERE {_CATEGORY} = 'Escolas' AND distrito = 'NATION_1'")
def dashboard_category_and_district(spark, sf_dir):
    return _dashboard(spark, sf_dir, category=(classify.category(F.col("titulo")), "Escolas"), district=(F.col("distrito"), "NATION_1"))


@query(f"{{T}} SELECT id FROM t WHERE contains({_PROCEDURE}, 'consulta previa') OR contains({_PROCEDURE}, 'empreitadas')")
def dashboard_procedures(spark, sf_dir):
    return _dashboard(spark, sf_dir, procedures=["Consulta Prévia", "EMPREITADAS"])


@query(f"{{T}} SELECT id FROM t WHERE coalesce({_SERVICE} IN ('Concurso de conceção', 'Elaboração de projeto'), false)")
def dashboard_services(spark, sf_dir):
    return _dashboard(spark, sf_dir, services=["Concurso de conceção", "Elaboração de projeto"])


@query(f"{{T}} SELECT id, 'ativos' AS cartao FROM t WHERE estado = 'aberto' UNION ALL SELECT id, 'novos' FROM t WHERE pub BETWEEN {_DAY} - 6 AND {_DAY} UNION ALL SELECT id, 'entidades' FROM t WHERE trim(entidade) <> ''")
def dashboard_cards(spark, sf_dir):
    cards = [_dashboard(spark, sf_dir, kind=k).withColumn("cartao", F.lit(k)) for k in ("ativos", "novos", "entidades")]
    return cards[0].union(cards[1]).union(cards[2])


@query(f"{{T}} SELECT id FROM t WHERE contains({_FIELDS}, 'projeto') AND {_CATEGORY} = 'Outros' AND contains({_PROCEDURE}, 'servicos') AND coalesce({_SERVICE} IN ('Elaboração de projeto', 'Revisão / Análise de projeto'), false) AND estado = 'aberto'")
def dashboard_all_filters(spark, sf_dir):
    return _dashboard(spark, sf_dir, search="projeto", category=(classify.category(F.col("titulo")), "Outros"), district=(F.col("distrito"), "Todos os distritos"), procedures=["serviços"], services=["Elaboração de projeto", "Revisão / Análise de projeto"], kind="ativos")


@query("{T} SELECT id FROM t WHERE (contains(lower(titulo), 'museu') OR contains(lower(coalesce(entidade, '')), 'museu')) AND estado = 'sem_prazo'")
def simple_list(spark, sf_dir):
    return _typed(spark, sf_dir).where(filters.simple_list("Museu", "sem_prazo")).select("id")


@query(f"{{T}} SELECT id, row_number() OVER (PARTITION BY date_trunc('month', pub) ORDER BY pub DESC, id DESC) AS lugar FROM t WHERE pub >= DATE '2001-06-01' AND pub < DATE '2001-07-01'")
def monthly_order(spark, sf_dir):
    """Latest first, ties by id; the place in that order is part of the row."""
    month = report.monthly_summary(_typed(spark, sf_dir), _as_of())
    return _places(month.select("id", "data_publicacao"), F.desc("data_publicacao"), F.desc("id"))


@query("{T} SELECT id, pub AS dia FROM t")
def dashboard_dates(spark, sf_dir):
    return notices(spark, sf_dir).select("id", dates.dashboard_date(F.col("data")).alias("dia"))


# Documents, updates ---------------------------------------------------------------------------------------------------------


@query("{T}, s AS (SELECT id, cpv, " + _SEARCH.format("titulo") + " AS x FROM t) SELECT id, id % 3 < 2 OR " + f"{_some('x', STRONG_WORDS)} OR {_some('x', PROJECT_WORDS)} OR ({_some('x', BUILDING_WORDS)} AND {_some('x', SERVICE_WORDS)}) AS relevante FROM s")
def looks_relevant(spark, sf_dir):
    return notices(spark, sf_dir).select("id", classify.looks_relevant(F.col("cpv"), F.col("titulo")).alias("relevante"))


_OLD_TEXT = "CASE id % 3 WHEN 0 THEN concat('Preço: ', id % 100, '%') WHEN 1 THEN concat('Qualidade - ', id % 50, ' %', chr(10), 'Ponderação do preço: 40%', chr(10), 'Prazo: 5%') ELSE 'sem critérios' END"


@query("{T} SELECT id, CASE id % 3 WHEN 0 THEN 'Monofator' WHEN 1 THEN 'Multifator' END AS tipo, CASE id % 3 WHEN 0 THEN concat('Preço ', id % 100, '%') WHEN 1 THEN concat('Qualidade ', id % 50, '% • Prazo 5%') END AS resumo FROM t")
def older_award_criteria(spark, sf_dir):
    df = notices(spark, sf_dir).select("id", extract.award_criteria(F.expr(_OLD_TEXT)).alias("c"))
    return df.select("id", extract.criteria_type(F.col("c")).alias("tipo"), extract.criteria_text(F.col("c")).alias("resumo"))


_SECTION = "concat('9 - Outros', chr(10), '10 - Critérios de adjudicação', chr(10), 'Preço ', id % 40, ',5%', chr(10), 'Nome: Equipa', chr(10), 'Ponderação: ', id % 9, '.0%', chr(10), '11 - Garantia 7%')"


@query("{T} SELECT id, concat('10 - Critérios de adjudicação', chr(10), 'Preço ', id % 40, ',5%', chr(10), 'Nome: Equipa', chr(10), 'Ponderação: ', id % 9, '.0%') AS seccao, concat(id % 40, '.5%') AS primeira, 'Equipa' AS nome, concat('Preço=', id % 40, '.5%|Ponderação=', id % 9, '%') AS fatores FROM t")
def criteria_sections(spark, sf_dir):
    df = notices(spark, sf_dir).select("id", extract.criteria_section(F.expr(_SECTION)).alias("seccao"))
    found = F.transform(extract.factors(F.col("seccao")), lambda x: F.concat_ws("=", x["nome"], x["peso"]))
    return df.select("id", "seccao", extract.percentage(F.col("seccao")).alias("primeira"), extract.factor_name(F.lit(" Nome: Equipa; ")).alias("nome"), F.array_join(found, "|").alias("fatores"))


@query("{T} SELECT id, link, id % 3 <> 0 AS antigo FROM t")
def append_to_checkpoint(spark, sf_dir):
    """New records beside the ones of a checkpoint, which win."""
    df = notices(spark, sf_dir).select("id", "link")
    return store.append_new(df.where("id % 3 <> 0").withColumn("antigo", F.lit(True)), df.withColumn("antigo", F.lit(False)))


_WITH_SUMMARY = "CASE WHEN id % 4 = 0 THEN NULL ELSE concat('A ', id % 3, ' • B', CASE WHEN id % 2 = 0 THEN ' •  B' ELSE '' END) END"


@query("{T} SELECT id, CASE WHEN id % 4 <> 0 THEN concat('A ', id % 3, ' • B') END AS criterio_resumo FROM t")
def criteria_cleaned(spark, sf_dir):
    return store.clean_criteria(notices(spark, sf_dir).withColumn("criterio_resumo", F.expr(_WITH_SUMMARY)))[0].select("id", "criterio_resumo")


@query("{T} SELECT id, CASE WHEN id % 3 = 2 THEN 'antigo' ELSE CASE id % 3 WHEN 0 THEN concat('Preço ', id % 100, '%') ELSE concat('Qualidade ', id % 50, '% • Prazo 5%') END END AS criterio_resumo FROM t")
def criteria_refreshed(spark, sf_dir):
    df = notices(spark, sf_dir)
    old = df.withColumns({c: F.lit("antigo") for c in ("criterio_tipo", "criterio_resumo", "criterio_detalhe")})
    return store.refresh_criteria(old, df.select("id", F.expr(_OLD_TEXT).alias("texto"))).select("id", "criterio_resumo")


@query("{T} SELECT id, CASE WHEN id % 3 = 0 THEN '05-07-2001 17:00' WHEN id % 3 = 1 THEN '09-07-2001' ELSE 'antiga' END AS entrega FROM t")
def delivery_dates_filled(spark, sf_dir):
    df = notices(spark, sf_dir).withColumn("data_entrega_propostas", F.lit("antiga")).withColumn("link_anuncio_dr", F.lit(None).cast("string"))
    found = df.select("link", extract.delivery_date(F.col("texto")).alias("data_entrega_propostas"), "link_anuncio_dr")
    return store.fill_delivery_dates(df, found).select("id", F.col("data_entrega_propostas").alias("entrega"))


@query("{T} SELECT id FROM t WHERE id % 4 <> 0 AND id % 2 = 0")
def weights_taken_for_names(spark, sf_dir):
    df = notices(spark, sf_dir).withColumn("criterio_resumo", F.expr("CASE WHEN id % 4 = 0 THEN NULL WHEN id % 2 = 0 THEN 'PONDEração 5%' ELSE 'Preço 5%' END"))
    return df.where(filters.with_criteria() & filters.with_weight_as_name()).select("id")


# Events --------------------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT user_id, event_type FROM events")
def incremental_dedup(spark, sf_dir):
    """Streamed from the events file, distinct keys kept across batches."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    work = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    return ingest_distinct(spark, source, ["user_id", "event_type"], f"{work}/out", f"{work}/state")


@query("SELECT CAST(date_trunc('month', ts) AS DATE) AS mes, event_type, count(*) AS n, round(sum(value), 4) AS valor FROM events GROUP BY 1, 2")
def monthly_events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.trunc("ts", "MM").cast("date").alias("mes"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("valor"))


from . import store_queries  # noqa: E402, F401  (registers its queries here)
