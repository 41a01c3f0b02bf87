"""Notices made from the orders, customers and nations of the test tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-07-01"
NOTICES_SQL = """
SELECT k AS id,
  CASE k % 10 WHEN 0 THEN 'Prestação de serviços de arquitetura para a Escola Básica' WHEN 1 THEN 'Elaboração de projeto de execução do Centro de Saúde'
    WHEN 2 THEN 'Fiscalização da empreitada de requalificação da rua' WHEN 3 THEN 'Revisão de projeto de arquitetura e especialidades'
    WHEN 4 THEN 'Aquisição de software e arquitetura de sistemas' WHEN 5 THEN 'Concurso de conceção para habitação'
    WHEN 6 THEN 'Repavimentação de estrada municipal' WHEN 7 THEN 'Coordenação de projeto para o Museu'
    WHEN 8 THEN 'Elaboração do projeto de rede de abastecimento de água' ELSE '  Fornecimento de mobiliário  ' END AS titulo,
  CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN '  ' ELSE n_name END AS entidade,
  concat('https://portal.example.org/detalhe/?type=anuncios&id=', cast(k AS string)) AS link,
  CASE k % 5 WHEN 0 THEN concat(substr(d, 9, 2), '-', substr(d, 6, 2), '-', substr(d, 1, 4)) WHEN 1 THEN concat(substr(d, 9, 2), '/', substr(d, 6, 2), '/', substr(d, 1, 4))
    WHEN 2 THEN d WHEN 3 THEN concat(d, 'T10:11:12') ELSE 'sem data' END AS data,
  CASE k % 7 WHEN 0 THEN concat(cast(k % 60 AS string), ' dias.') WHEN 1 THEN concat(cast(k % 45 AS string), ' dias úteis') WHEN 2 THEN NULL WHEN 3 THEN ' '
    WHEN 4 THEN '15-07-2001' WHEN 5 THEN '0 dias' ELSE 'n/d' END AS data_limite,
  CASE k % 6 WHEN 0 THEN concat(t, '.', r, ',50 €') WHEN 1 THEN concat(v, '.25') WHEN 2 THEN concat(v, ' €') WHEN 3 THEN NULL WHEN 4 THEN 'n/d' ELSE concat(t, '.', r) END AS preco_base,
  CASE k % 3 WHEN 0 THEN '71200000-0, Serviços de arquitetura' WHEN 1 THEN '71400000-2; 45000000-7' ELSE '45000000-7' END AS cpv,
  CASE k % 4 WHEN 0 THEN 'Aquisição de serviços; Concurso público' WHEN 1 THEN 'Empreitadas de obras públicas; Concurso público' WHEN 2 THEN 'Aquisição de serviços; Consulta prévia' ELSE NULL END AS tipo_procedimento,
  CASE WHEN k % 13 = 0 THEN 0 WHEN k % 11 = 0 THEN NULL ELSE 1 END AS relevante,
  concat('Nome: Qualidade', chr(10), 'Ponderação: ', cast(k % 90 AS string), '%', chr(10), 'Nome: Preço', chr(10), 'Ponderação: ', cast(100 - k % 90 AS string), '%', chr(10),
    CASE k % 3 WHEN 0 THEN 'Prazo para apresentação das propostas: 05-07-2001 17:00' WHEN 1 THEN 'Data limite para apresentação das propostas: 09-07-2001' ELSE 'sem prazo' END, chr(10),
    CASE k % 9 WHEN 0 THEN 'Objeto: elaboração  de projeto de arquitetura' WHEN 1 THEN 'Inclui a fiscalização da obra' WHEN 2 THEN 'Inclui a REDE DE SANEAMENTO' WHEN 3 THEN 'Plataforma com arquitetura de dados'
      WHEN 4 THEN 'Coordenação do projeto' WHEN 5 THEN 'Serviços de arquitetura de interiores' ELSE '' END) AS texto,
  CASE WHEN k % 23 = 0 THEN NULL WHEN k % 29 = 0 THEN '' ELSE n_name END AS distrito,
  CASE WHEN k % 3 = 0 THEN NULL WHEN k % 31 = 0 THEN '' ELSE concat('Município ', cast(k % 12 AS string)) END AS municipio
FROM (
  SELECT o_orderkey AS k, n_name, cast(cast(o_orderdate AS date) AS string) AS d, cast(cast(floor(o_totalprice) AS bigint) AS string) AS v,
    cast(cast(floor(floor(o_totalprice) / 1000.0) AS bigint) AS string) AS t, lpad(cast(cast(floor(o_totalprice) AS bigint) % 1000 AS string), 3, '0') AS r
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
) s
"""


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as tasks can run at least: a small file is one partition, and one task would do all work on its rows."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation")}
    columns = ("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return spark.sql(NOTICES_SQL, **tables | {"orders": spread(tables["orders"].select(*columns))})


def details(df: DataFrame) -> DataFrame:
    """Detail records of every other notice, some fields blank, as a lookup would give them."""
    return df.where("id % 2 = 0").selectExpr(
        "id",
        "link",
        "CASE WHEN id % 3 = 0 THEN '' ELSE upper(titulo) END AS titulo",
        "CASE WHEN id % 5 = 0 THEN '1.000,00 €' END AS preco_base",
        "CASE WHEN id % 4 = 0 THEN '10 dias' ELSE ' ' END AS data_limite",
    )


#: The flat fields of a raw record, by SQL that both run; raw_notices adds lists.
_RAW_FLAT = {
    "id": "cast(id AS string)",
    "contractDesignation": "CASE WHEN id % 4 = 0 THEN ' ' ELSE titulo END",
    "description": "CASE WHEN id % 8 = 0 THEN NULL WHEN id % 7 = 3 THEN 'Elaboração de projeto de arquitetura' ELSE titulo END",
    "contractingEntity": "CASE WHEN id % 6 = 1 THEN entidade END",
    "entity": "CASE WHEN id % 5 = 0 THEN NULL ELSE entidade END",
    "contractType": "CASE WHEN id % 2 = 0 THEN 'Aquisição de serviços' ELSE '' END",
    "contractingProcedureType": "CASE id % 3 WHEN 0 THEN 'Concurso público' WHEN 1 THEN 'Aquisição de serviços' ELSE '' END",
    "modelType": "CASE id % 7 WHEN 0 THEN 'Anúncio de procedimento' WHEN 1 THEN 'Concurso de conceção' WHEN 2 THEN '' END",
    "type": "CASE id % 5 WHEN 0 THEN 'Anúncio' WHEN 1 THEN 'Aquisição de serviços' END",
    "basePrice": "preco_base",
    "proposalDeadline": "data_limite",
    "drPublicationDate": "data",
    "announcementNumber": "CASE WHEN id % 4 = 1 THEN concat(cast(id AS string), '/2001') END",
    "reference": "CASE WHEN id % 5 < 4 THEN concat('https://dre.example.org/', cast(id AS string), '.pdf') END",
}
RAW_SQL = "id AS k, " + ", ".join(f"{v} AS {k}" for k, v in _RAW_FLAT.items())
_DETAIL_FLAT = {
    "id": "cast(id AS string)",
    "contractDesignation": "CASE WHEN id % 3 = 0 THEN '' WHEN id % 10 = 2 THEN 'Serviços de arquitetura' ELSE upper(titulo) END",
    "contractType": "CASE WHEN id % 14 = 0 THEN 'Prestação de serviços' END",
    "basePrice": "CASE WHEN id % 5 = 0 THEN '1.000,00 €' END",
    "proposalDeadline": "CASE WHEN id % 4 = 0 THEN '10 dias' WHEN id % 4 = 1 THEN '2001-08-01' ELSE '' END",
}
RAW_DETAIL_SQL = "id AS k, " + ", ".join(f"{v} AS {k}" for k, v in _DETAIL_FLAT.items())


def raw_notices(df: DataFrame) -> DataFrame:
    """Notices in the layout of raw records."""
    none = "cast(NULL AS string)"
    lists = (
        "CASE WHEN id % 3 = 0 THEN array(named_struct('description', concat(' Câmara  ', id % 5)), named_struct('description', CASE WHEN id % 2 = 0 THEN 'Junta' ELSE concat('Câmara ', id % 5) END)) END AS contractingEntities",
        """CASE id % 3 WHEN 0 THEN array('{"code": "71200000-0", "description": "Serviços de arquitetura"}', '45000000-7', ' ') WHEN 1 THEN array('71400000-2', '{"cpv": "71400000-2"}') END AS cpvs""",
    )
    others = ("entityName", "contractingEntityName", "contractingProcedureUrl", "contractingProcedureId")
    return df.selectExpr(*(f"{v} AS {k}" for k, v in _RAW_FLAT.items()), *lists, *(f"{none} AS {c}" for c in others))


def raw_details(df: DataFrame) -> DataFrame:
    """Raw detail records of every other notice, some fields empty."""
    return df.where("id % 2 = 0").selectExpr(*(f"{v} AS {k}" for k, v in _DETAIL_FLAT.items()))


def gazettes(df: DataFrame) -> DataFrame:
    """(link_anuncio_dr, texto): what the documents that raw records refer to say."""
    return df.where("id % 5 < 4").selectExpr("concat('https://dre.example.org/', cast(id AS string), '.pdf') AS link_anuncio_dr", "texto")


DUCK_NOTICES = "notices AS (" + NOTICES_SQL.format(orders="orders", customer="customer", nation="nation") + ")"
DUCK_DETAILS = """details AS (SELECT id, link, CASE WHEN id % 3 = 0 THEN '' ELSE upper(titulo) END AS titulo,
  CASE WHEN id % 5 = 0 THEN '1.000,00 €' END AS preco_base, CASE WHEN id % 4 = 0 THEN '10 dias' ELSE ' ' END AS data_limite FROM notices WHERE id % 2 = 0)"""
