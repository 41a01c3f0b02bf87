"""Statistics, rankings, monthly measures and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_or
from .filters import filled, published_between


def statistics(df: DataFrame) -> DataFrame:
    """One row, one pass."""
    return df.agg(
        F.count("*").alias("total_concursos"),
        F.count_if(F.col("relevante") == 1).alias("concursos_relevantes"),
        F.count_if(filled("preco_base")).alias("com_preco"),
        F.count_if(filled("data_limite")).alias("com_prazo"),
    )


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent filled values, ties in order of the value."""
    found = df.where(filled(column)).groupBy(column).agg(F.count("*").alias("total"))
    return found.orderBy(F.desc("total"), column).limit(n)


def counts_first_seen(df: DataFrame, column: str, default: str, order: str = "id") -> DataFrame:
    """Counts with a placeholder for blanks, most frequent first, ties by first appearance."""
    found = df.groupBy(text_or(F.col(column), default).alias(column)).agg(F.count("*").alias("total"), F.min(order).alias("primeiro"))
    return found.orderBy(F.desc("total"), "primeiro")


def price_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("preco").alias("n_precos"), F.sum("preco").alias("soma"), F.avg("preco").alias("media"))


def presence(df: DataFrame) -> DataFrame:
    there = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c) != ""))
    return df.agg(there("preco_base").alias("com_preco"), there("data_limite").alias("com_prazo"))


def monthly(df: DataFrame) -> DataFrame:
    """Measures of each calendar month of publication."""
    entity = F.nullif(F.trim("entidade"), F.lit(""))
    return df.where("data_publicacao is not null").groupBy(F.trunc("data_publicacao", "MM").alias("mes")).agg(
        F.count("*").alias("total"),
        F.count_distinct(entity).alias("entidades"),
        F.count("preco").alias("com_preco"),
        F.sum("preco").alias("valor_total"),
        F.avg("preco").alias("valor_medio"),
        F.count_if(filled("data_limite")).alias("com_prazo"),
        F.count_if(F.col("estado") == "aberto").alias("abertos"),
    )


def with_previous(months: DataFrame, *columns: str) -> DataFrame:
    """Each measure beside the previous row's; months are few, so one window holds them."""
    w = Window.orderBy("mes")
    return months.select("*", *(F.lag(c).over(w).alias(f"{c}_anterior") for c in columns))


def two_periods(df: DataFrame, now: tuple[Column, Column], before: tuple[Column, Column]) -> DataFrame:
    """Counts and values of two periods in one conditional pass."""
    a, b = published_between(*now), published_between(*before)
    value = lambda p: F.coalesce(F.sum(F.when(p, F.col("preco"))), F.lit(0))
    return df.agg(
        F.count_if(a).alias("atual"),
        F.count_if(b).alias("anterior"),
        F.count_distinct(F.when(a, F.nullif(F.trim("entidade"), F.lit("")))).alias("entidades_atual"),
        F.count_distinct(F.when(b, F.nullif(F.trim("entidade"), F.lit("")))).alias("entidades_anterior"),
        value(a).alias("valor_atual"),
        value(b).alias("valor_anterior"),
    )


def share_of_most(df: DataFrame, column: str = "total") -> DataFrame:
    """Bar width of each row of a short ranking."""
    from ..functions.money import bar_width

    return df.withColumn("largura", bar_width(F.col(column), F.max(column).over(Window.partitionBy())))


def distinct_sorted(df: DataFrame, column: str, collation: str = "pt") -> DataFrame:
    values = df.where(filled(column)).select(column).distinct()
    return values.orderBy(F.collate(F.col(column), collation))


def run_counters(classified: DataFrame, store: DataFrame) -> DataFrame:
    """Counts of a run: analysed, relevant, excluded, new and existing ones, and updates that reach a row."""
    known = store.select("link", F.lit(True).alias("_known"))
    out = classified.join(known, "link", "left").withColumn("_r", F.col("analise.relevante"))
    return out.agg(
        F.count("*").alias("analisados"),
        F.count_if("_r").alias("relevantes"),
        F.count_if(~F.col("_r")).alias("excluidos"),
        F.count_if(F.col("_r") & F.col("_known").isNull()).alias("novos"),
        F.count_if(F.col("_r") & F.col("_known")).alias("existentes"),
        F.count_if(F.col("_r") & F.col("_known") & (F.trim("link") != "")).alias("atualizados"),
    )
