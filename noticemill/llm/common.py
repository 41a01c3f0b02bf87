"""What several operators share: reading, stored tables, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stored import Scratch, shared_folder

__all__ = ["Scratch", "components", "line_hash", "shared_folder", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): a row (id, component) for each id in an edge, component the smallest id.

    Local contraction: in each round every id draws a fresh priority by hash and joins the id of least priority among
    itself and its neighbours; edges are contracted to those. A round is expected to leave half of a chain's ids and
    fewer of denser graphs, so rounds grow with the logarithm of the ids, whatever the shape. Each round's table of
    (id, least id below it, parent) shrinks alike; from the last to the first they hand the component down. The joins
    read stored tables or keys that are unique, so that adaptive execution can split a hub's rows over tasks.
    Null ids have no links.
    """
    scratch = Scratch(edges.sparkSession)
    ordered = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    left = scratch.keep(edges.where("u <> v").select(*ordered("u", "v")).distinct())
    nodes = left.select(F.col("u").alias("id")).union(left.select("v")).distinct().withColumn("low", F.col("id"))
    trees: list[DataFrame] = []
    while not left.isEmpty():
        drawn = lambda c: F.struct(F.xxhash64(F.lit(len(trees)), c).alias("draw"), F.col(c).alias("id"))  # noqa: B023, E731
        around = left.union(left.select("v", "u")).groupBy("u").agg(F.min(drawn("v")).alias("best"))
        parent = F.least("best", drawn("u"))["id"]
        tree = scratch.keep(nodes.join(around.select(F.col("u").alias("id"), parent.alias("p")), "id", "left"))
        trees.append(tree)
        nodes = tree.where("p is not null").groupBy(F.col("p").alias("id")).agg(F.min("low").alias("low"))
        a, b = tree.select(F.col("id").alias("u"), F.col("p").alias("pu")), tree.select(F.col("id").alias("v"), F.col("p").alias("pv"))
        contracted = left.join(a, "u").join(b, "v").where("pu <> pv").select(*ordered("pu", "pv")).distinct()
        before, left = left, scratch.keep(contracted)
        scratch.drop(before)
    found = scratch.keep(nodes.withColumnRenamed("low", "component"))
    for tree in reversed(trees):
        upper = found.select(F.col("id").alias("p"), "component")
        lower = tree.join(upper, "p", "left").select("id", F.coalesce("component", "low").alias("component"))
        above, found = found, scratch.keep(lower)
        scratch.drop(above, tree)
    return found


def line_hash(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes, for names that must not collide by chance."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(0x5EED), *columns)
