"""Queries over the versioned notice table, its stream and its indexes, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import classify, dates, extract, text
from .operators import measures, project, search_index, store, versions
from .plans import listing, paging, pipeline
from .queries import _DAY, _OVER, _READ, _RUN, _RUN_STORE, _as_of, _d_date, _normalised, _page, query
from .schema import align
from .sources import notices as source
from .sources import pages
from .sources.fixtures import RAW_SQL, gazettes, notices, raw_details, raw_notices
from .stored import Scratch
from .streaming import lookback
from .streaming.upserts import stream_upserts

#: Updates of every fifth notice: a new title and date, a blank price that changes nothing.
UPDATES_SQL = "SELECT link, concat('Novo título ', cast(id AS string)) AS titulo, CASE WHEN id % 10 = 0 THEN '15-06-2001' END AS data, ' ' AS preco_base, CASE WHEN id % 15 = 0 THEN '3 dias' END AS data_limite, cpv FROM {rows} WHERE id % 5 = 0"
_MERGED = (
    f"{{T}}, u AS ({UPDATES_SQL.format(rows='t')}), "
    "m AS (SELECT t.link, t.entidade, coalesce(u.titulo, t.titulo) AS titulo, coalesce(u.data, t.data) AS data, t.preco_base, coalesce(nullif(trim(u.data_limite), ''), t.data_limite) AS data_limite FROM t LEFT JOIN u ON t.link = u.link WHERE t.id % 2 = 0 "
    "UNION ALL SELECT u.link, NULL, u.titulo, u.data, NULL, u.data_limite FROM u JOIN t ON t.link = u.link WHERE t.id % 2 = 1), "
    f"p AS (SELECT m.*, {_d_date('m.data')} AS pub FROM m) "
)


def _table(spark, sf_dir, where: str = "id % 2 = 0") -> versions.Version:
    return versions.create(spark, f"{Scratch(spark).folder}/table", notices(spark, sf_dir).where(where), buckets=4, parts=2)


def _updates(spark, sf_dir) -> DataFrame:
    return spark.sql(UPDATES_SQL.format(rows="{rows}"), rows=notices(spark, sf_dir))


@query("{T} SELECT id, pub AS data_publicacao, fim AS data_fim, CAST(preco AS VARCHAR) AS preco FROM t WHERE pub >= DATE '2001-05-01' AND pub < DATE '2001-07-01'")
def table_period(spark, sf_dir):
    """Two months of the typed table: other months' folders are not read."""
    rows = versions.read(spark, _table(spark, sf_dir, "true"))
    out = versions.published(rows, F.lit("2001-05-01").cast("date"), F.lit("2001-07-01").cast("date"))
    return out.select("id", "data_publicacao", "data_fim", F.col("preco").cast("string").alias("preco"))


@query(f"{{T}} SELECT id FROM t WHERE pub IS NULL OR pub >= {_DAY} - 7")
def table_lookback(spark, sf_dir):
    return versions.since(versions.read(spark, _table(spark, sf_dir, "true")), F.date_sub(_as_of(), 7)).select("id")


@query(_MERGED + "SELECT link, titulo, data, preco_base, data_limite, pub AS data_publicacao, CASE WHEN pub IS NULL THEN 0 ELSE year(pub) * 100 + month(pub) END AS mes FROM p")
def table_merged(spark, sf_dir):
    """The table after a merge that inserts, updates and moves rows between months."""
    after = versions.merge(spark, _table(spark, sf_dir), _updates(spark, sf_dir))
    return versions.read(spark, after).select("link", "titulo", "data", "preco_base", "data_limite", "data_publicacao", F.col("mes").cast("long").alias("mes"))


@query("{T} SELECT count(*) FILTER (WHERE id % 2 = 1) AS inserted, count(*) FILTER (WHERE id % 2 = 0) AS updated, CAST(0 AS BIGINT) AS deleted, (SELECT count(*) FROM t WHERE id % 2 = 0 AND id % 5 <> 0) AS unchanged FROM t WHERE id % 5 = 0")
def table_changes(spark, sf_dir):
    """What a merge has inserted, updated and left, from the difference of two versions."""
    before = _table(spark, sf_dir)
    after = versions.merge(spark, before, _updates(spark, sf_dir))
    counts = versions.change_counts(versions.changes(spark, before, after, "link"))
    whole = versions.read(spark, after).agg(F.count("*").alias("n"))
    return counts.crossJoin(whole).select("inserted", "updated", "deleted", (F.col("n") - F.col("inserted") - F.col("updated")).alias("unchanged"))  # one row each


@query(_MERGED + "SELECT link, titulo, data, preco_base, data_limite, pub AS data_publicacao FROM p")
def streamed_upserts(spark, sf_dir):
    """The same updates from landed files, a batch a file, through the stream into the table."""
    folder = Scratch(spark).folder
    updates = _updates(spark, sf_dir)
    updates.repartition(3, "link").write.parquet(f"{folder}/landed")
    table = _table(spark, sf_dir)
    source = spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/landed")
    after = stream_upserts(source, table.root, "updates", f"{folder}/state")
    return versions.read(spark, after).select("link", "titulo", "data", "preco_base", "data_limite", "data_publicacao")


def _current(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("data_fim").isNull() | (F.col("data_fim") >= _as_of()))


@query("{T} SELECT id, titulo, pub AS data_publicacao FROM t WHERE estado <> 'encerrado' ORDER BY pub DESC NULLS LAST, id DESC LIMIT 50 OFFSET 700")
def page_by_key(spark, sf_dir):
    """The fifteenth page of the table, from the range of dates and ids that it lies in."""
    rows = _current(versions.read(spark, _table(spark, sf_dir, "true")))
    return paging.page_by_key(rows, paging.borders(rows, 500), 15, 50).select("id", "titulo", "data_publicacao")


_TERMS = ["museu", "ão de", "é", "NATION_1", "71200000-0", "ío", "xyz", "a"]


@query(
    "{T}, w AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in _TERMS) + "]) AS termo) SELECT termo, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM t, w WHERE contains(lower(titulo), lower(termo)) OR contains(lower(coalesce(entidade, '')), lower(termo)) OR contains(lower(coalesce(cpv, '')), lower(termo)) GROUP BY termo"
)
def search_index_hits(spark, sf_dir):
    """Terms of one and more characters through the index; hits are checked against their rows."""
    rows = notices(spark, sf_dir)
    index = search_index.build(rows, f"{Scratch(spark).folder}/index")
    out = None
    for term in _TERMS:
        hits = search_index.search(rows, index, term).select(F.lit(term).alias("termo"), "id")
        out = hits if out is None else out.union(hits)
    return out.groupBy("termo").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(
    _MERGED + f", q AS (SELECT p.pub, p.entidade, p.data_limite, t.preco FROM p JOIN t ON p.link = t.link WHERE t.id % 2 = 0 UNION ALL SELECT p.pub, p.entidade, p.data_limite, NULL FROM p JOIN t ON p.link = t.link WHERE t.id % 2 = 1) "
    "SELECT CAST(date_trunc('month', pub) AS DATE) AS mes, count(*) AS total, count(DISTINCT nullif(trim(entidade), '')) AS entidades, count(preco) AS com_preco, CAST(CAST(sum(preco) AS DECIMAL(38,6)) AS VARCHAR) AS valor_total, count(*) FILTER (WHERE trim(data_limite) <> '') AS com_prazo FROM q WHERE pub IS NOT NULL GROUP BY 1"
)
def monthly_increments(spark, sf_dir):
    """Monthly measures carried over three merges by what each has changed."""
    scratch, updates = Scratch(spark), _updates(spark, sf_dir)
    version = _table(spark, sf_dir)
    kept = scratch.keep(measures.partials(versions.read(spark, version)))
    for third in range(3):
        after = versions.merge(spark, version, updates.where(F.pmod(F.xxhash64("link"), F.lit(3)) == third))
        kept, version = scratch.keep(measures.advanced_to(spark, kept, version, after)), after
    return measures.monthly(kept).withColumn("valor_total", F.col("valor_total").cast("decimal(38,6)").cast("string"))


@query(f"{{T}} SELECT CAST(id AS VARCHAR) AS id FROM t WHERE pub IS NULL OR pub >= {_DAY} - 60")
def paged_listing(spark, sf_dir):
    """Landed pages, newest first, read up to the first one with an older row."""
    root, raw = f"{Scratch(spark).folder}/pages", raw_notices(notices(spark, sf_dir))
    pages.land_pages(raw, root, 500)
    return pages.read_recent(spark, root, raw.schema, _as_of(), 60, 500).select("id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-11'")
def lookback_stream(spark, sf_dir):
    """Events in four landed files by time, the first two delivered again at the end: each event once, none before the lookback."""
    folder = Scratch(spark).folder
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    days = ["2024-01-01", "2024-01-08", "2024-01-16", "2024-01-24", "2024-02-01"]
    for i in (0, 1, 2, 3, 0, 1):
        part = events.where((F.col("ts") >= F.lit(days[i]).cast("timestamp")) & (F.col("ts") < F.lit(days[i + 1]).cast("timestamp")))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/landed")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/landed")
    lookback.run_within(spark, source, ["event_id"], "ts", F.lit("2024-01-11").cast("timestamp"), f"{folder}/out", f"{folder}/state", "9 days")
    return spark.read.parquet(f"{folder}/out").select("event_id")


@query(_page("estado <> 'encerrado'"))
def table_listing_page1(spark, sf_dir):
    """The first page of current notices from the stored table: nothing is parsed, files that have ended are skipped."""
    return listing.listing(versions.read(spark, _table(spark, sf_dir, "true")), _as_of())[0]


def _table_run(spark, sf_dir) -> pipeline.TableRun:
    df = notices(spark, sf_dir)
    raw = raw_notices(df)
    seen = pipeline.record_layout(raw.where("cast(id AS long) % 7 = 0"))
    return pipeline.run_table(raw, raw_details(df), gazettes(df), seen, _table(spark, sf_dir).root, _as_of(), pipeline.Config(days=3650))


@query(_RUN + _RUN_STORE)
def daily_run_table(spark, sf_dir):
    """The daily run on the versioned table."""
    return versions.read(spark, _table_run(spark, sf_dir).after).select("link", *_OVER, *_READ)


_DIFFERENT = " OR ".join(f"coalesce(nullif(trim(v.{c}), ''), t.{c}) IS DISTINCT FROM t.{c}" for c in _OVER) + " OR " + " OR ".join(f"v.{c} IS NOT NULL" for c in _READ)


@query(_RUN + f"SELECT (SELECT count(*) FROM v WHERE no % 2 = 1) AS inserted, (SELECT count(*) FROM t JOIN v ON t.link = v.link WHERE t.id % 2 = 0 AND ({_DIFFERENT})) AS updated, CAST(0 AS BIGINT) AS deleted")
def daily_run_changes(spark, sf_dir):
    """Rows that the daily run has made or made different, from two versions of the table."""
    return versions.change_counts(_table_run(spark, sf_dir).changes)


# Sources, sinks and small forms -------------------------------------------------------------------------------------------


@query("{T}, r AS (SELECT " + RAW_SQL + " FROM t) SELECT id_portal_base, titulo, entidade, cpv FROM (" + _normalised("r") + ")")
def envelopes_read(spark, sf_dir):
    """Raw records landed as envelopes, a page a line, and read again."""
    folder, raw = Scratch(spark).folder, raw_notices(notices(spark, sf_dir))
    page = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.lit(raw.count() // 25)))  # some 25 records a page
    raw.groupBy(page.alias("page")).agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("items")), {"ignoreNullFields": "false"}).alias("value")).select("value").write.text(f"{folder}/pages")
    return project.normalised(source.read_notices(spark, f"{folder}/pages")).select("id_portal_base", "titulo", "entidade", "cpv")


@query("{T} SELECT id, link, titulo FROM t WHERE id % 7 <> 0")
def checkpoint_read(spark, sf_dir):
    """Checkpoint files, an array each, of which one in seven is broken off: its records are left out."""
    folder, df = Scratch(spark).folder, notices(spark, sf_dir).select("id", "link", "titulo")
    whole = F.to_json(F.collect_list(F.struct("id", "link", "titulo")))
    group = F.struct((F.col("id") % 7).alias("seventh"), F.pmod(F.xxhash64("id"), F.lit(4)).alias("file"))
    files = df.groupBy(group.alias("g")).agg(whole.alias("value"))
    broken = files.select(F.when(F.col("g.seventh") == 0, F.expr("substr(value, 1, length(value) - 5)")).otherwise(F.col("value")).alias("value"))
    broken.write.option("maxRecordsPerFile", 1).text(f"{folder}/checkpoint")
    return source.read_checkpoint(spark, f"{folder}/checkpoint", df.schema)


@query("{T} SELECT id, relevante FROM t WHERE coalesce(relevante, 1) = 1")
def relevant_or_unknown(spark, sf_dir):
    return source.stored_relevant(notices(spark, sf_dir)).select("id", "relevante")


@query("{T} SELECT id, titulo, coalesce(nullif(trim(preco_base), ''), '-') AS preco_base FROM t")
def snapshot_latest(spark, sf_dir):
    """The later of two snapshots; the earlier one stays beside it."""
    root, df = f"{Scratch(spark).folder}/snapshots", align(notices(spark, sf_dir))
    store.write_snapshot(df, root)
    store.write_snapshot(df.withColumn("preco_base", F.coalesce(text.blank_to_null(F.col("preco_base")), F.lit("-"))), root)
    return store.read_snapshot(spark, root).select("id", "titulo", "preco_base")


@query("{T} SELECT id, link, data, preco_base FROM t")
def results_written(spark, sf_dir):
    """All results as JSON lines, read again."""
    folder, df = Scratch(spark).folder, notices(spark, sf_dir).select("id", "link", "data", "preco_base")
    source.write_notices(df, f"{folder}/results")
    return spark.read.schema(df.schema).json(f"{folder}/results")


@query(
    "{T} SELECT id, coalesce(nullif(municipio, ''), nullif(distrito, ''), nullif(entidade, ''), 'Portugal') AS lugar, CASE estado WHEN 'aberto' THEN 'Aberto' WHEN 'encerrado' THEN 'Encerrado' ELSE 'Sem prazo' END AS nome_estado, "
    "left(titulo, 20) AS curto, array_to_string(list_transform(string_split(tipo_procedimento, ';'), lambda x: trim(x)), '|') AS tipos, CASE WHEN cpv IS NULL THEN 0 ELSE 1 END AS n_lista FROM t"
)
def card_fields(spark, sf_dir):
    """What a notice's card shows beside its dates."""
    return project.typed(notices(spark, sf_dir), _as_of()).select(
        "id",
        project.location(F.col("municipio"), F.col("distrito"), F.col("entidade")).alias("lugar"),
        classify.state_label(F.col("estado")).alias("nome_estado"),
        text.shortened(F.col("titulo"), 20).alias("curto"),
        F.array_join(text.split_trimmed(F.col("tipo_procedimento"), ";"), "|").alias("tipos"),
        F.size(text.as_list(F.col("cpv"))).alias("n_lista"),
    )


@query(
    "{T} SELECT id, CASE WHEN len(data) - len(replace(data, '-', '')) = 2 THEN concat(string_split(data, '-')[3], '/', string_split(data, '-')[2], '/', string_split(data, '-')[1]) ELSE data END AS publicado, "
    "CASE id % 3 WHEN 0 THEN '05/07/2001 17:00' WHEN 1 THEN '09/07/2001' ELSE 'Sem data' END AS entrega, CASE WHEN id % 5 IN (2, 3) THEN strftime(pub, '%d/%m/%Y') ELSE data END AS historico FROM t"
)
def display_dates(spark, sf_dir):
    df = notices(spark, sf_dir)
    return df.select("id", dates.display_date(F.col("data")).alias("publicado"), dates.display_delivery(extract.delivery_date(F.col("texto"))).alias("entrega"), dates.display_history(F.col("data")).alias("historico"))
