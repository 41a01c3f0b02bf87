"""Monthly measures kept up by increments: partial aggregates by month and entity that rows are added to and taken from.

Each partial has counts and sums that are exact under both, so that what a merge has changed is all that is read: the rows
of the folders that it has replaced are taken away, those of the new ones added. An entity counts in a month as long as rows
of it are left there, which makes distinct counts exact as well.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import filled
from .versions import UNDATED, Version, read

_KEY = ["mes", "entidade"]
_SUMS = ["n", "com_preco", "valor", "com_prazo"]


def partials(rows: DataFrame) -> DataFrame:
    """(mes, entidade, n, com_preco, valor, com_prazo) of typed rows; blank entities are null."""
    entity = F.nullif(F.trim("entidade"), F.lit(""))
    return rows.groupBy("mes", entity.alias("entidade")).agg(
        F.count("*").alias("n"), F.count("preco").alias("com_preco"), F.coalesce(F.sum("preco"), F.lit(0)).cast("decimal(38,6)").alias("valor"), F.count_if(filled("data_limite")).alias("com_prazo")
    )


def advanced(kept: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """Partials after rows have gone and come."""
    less = partials(gone).select(*_KEY, *((-F.col(c)).alias(c) for c in _SUMS))
    both = kept.unionByName(less).unionByName(partials(come))
    return both.groupBy(*_KEY).agg(*(F.sum(c).cast("decimal(38,6)" if c == "valor" else "long").alias(c) for c in _SUMS)).where("n <> 0")


def advanced_to(spark: SparkSession, kept: DataFrame, before: Version, after: Version) -> DataFrame:
    """Partials of one version from those of an earlier one, reading the folders alone that they don't share."""
    only = lambda x, y: read(spark, replace(x, folders=tuple(f for f in x.folders if f not in set(y.folders))))
    return advanced(kept, only(before, after), only(after, before))


def monthly(kept: DataFrame) -> DataFrame:
    """mes (first day), total, entidades, com_preco, valor_total, com_prazo of each month of publication."""
    day = F.make_date(F.floor(F.col("mes") / 100).cast("int"), F.col("mes") % 100, F.lit(1))
    return kept.where(F.col("mes") != UNDATED).groupBy(day.alias("mes")).agg(
        F.sum("n").alias("total"),
        F.count("entidade").alias("entidades"),
        F.sum("com_preco").alias("com_preco"),
        F.when(F.sum("com_preco") > 0, F.sum("valor")).alias("valor_total"),
        F.sum("com_prazo").alias("com_prazo"),
    )


def top_of_month(kept: DataFrame, month: int, n: int = 5) -> DataFrame:
    """The n entities with most notices of a month (YYYYMM), ties in order of the name."""
    return kept.where((F.col("mes") == month) & F.col("entidade").isNotNull()).orderBy(F.desc("n"), "entidade").limit(n).select("entidade", F.col("n").alias("total"))
