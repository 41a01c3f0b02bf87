"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine c or more lie within squared distance 2 - 2c. They are rotated and split into blocks of few
dimensions, and the budget is shared out in proportion to these: a pair within the whole budget is within its share
in one block at least. Each block is range-joined on a grid over its first dimensions, with cells of twice the radius:
a vector stands in its home cell and looks into the cells that its ball meets, found by their distance. The union of
all candidates is verified exactly. The more vectors a label has, the more dimensions the grid gets, up to the whole
block: a vector then meets fewer others for some more cells to look into. Equal vectors are one class from the start,
and only classes are paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

COSINE = 0.98
#: Dimensions of a block; of its grid the least, one more for each threefold of EVEN distinct vectors of a label.
BLOCK, LEAST = 8, 3
EVEN = 7_000
SEED = 20


def rotation(n: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, n)))[0]


def blocks(n: int) -> list[np.ndarray]:
    """n dimensions in blocks of BLOCK or fewer."""
    return np.array_split(np.arange(n), -(-n // BLOCK))


def _cells(x: np.ndarray, budget: float, salt: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The home cell of each row of a block's grid, and the cells that the ball of its budget meets, its own among them.

    Cells are twice as wide as the radius, so in each dimension a ball meets one neighbour at most, the nearer one.
    A cell's name is a sum of multiples of odd numbers; names that collide by chance only make more candidates.
    """
    wide = 2 * np.sqrt(budget)
    own = np.floor(x / wide)
    share = x / wide - own
    factor = np.random.default_rng(salt).integers(1, 1 << 62, x.shape[1]) * 2 + 1
    home = (own.astype(np.int64) * factor).sum(axis=1) + salt
    step = np.where(share < 0.5, -1, 1) * factor
    far = (np.minimum(share, 1 - share) * wide) ** 2
    masks = (np.arange(1 << x.shape[1])[:, None] >> np.arange(x.shape[1]) & 1).astype(bool)
    met = []
    for at in range(0, len(x), 2000):
        within = far[at : at + 2000] @ masks.T <= budget
        names = home[at : at + 2000, None] + step[at : at + 2000] @ masks.T.astype(np.int64)
        met += [row[ok] for row, ok in zip(names, within)]
    return home, met


def _placed(cosine: float):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            flat, ends = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            sizes = np.diff(ends)
            for n, d in sorted(set(zip(sizes.tolist(), dims.tolist()))):
                own = np.flatnonzero((sizes == n) & (dims == d))
                v = flat[ends[own][:, None] + np.arange(n)]
                turned = v / np.linalg.norm(v, axis=1, keepdims=True) @ rotation(n)
                for k, places in enumerate(blocks(n)):
                    x = turned[:, places]
                    budget = (2 - 2 * cosine) * len(places) / n + 1e-6  # coordinates are sent as floats
                    home, met = _cells(x[:, :d], budget, n * 100_000 + k)
                    flatten = pa.ListArray.from_arrays(np.cumsum([0] + list(map(len, met)), dtype=np.int32), np.concatenate(met))
                    padded = np.zeros((len(own), BLOCK), np.float32)
                    padded[:, : len(places)] = x
                    columns = [pa.array(ids[own]), pa.array(np.full(len(own), budget)), pa.array(home), flatten, *map(pa.array, np.ascontiguousarray(padded.T))]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "budget", "home", "met", *(f"x{i}" for i in range(BLOCK))])

    return place


_PLACED = "id long, budget double, home long, met array<long>, " + ", ".join(f"x{i} float" for i in range(BLOCK))


def cosine_of(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def scaled(v: str) -> Column:
    """v divided by a power of two, exactly, so that its greatest component is between 1 and 2: squares neither vanish nor overflow."""
    most = F.array_max(F.transform(v, F.abs))
    return F.zip_with(v, F.array_repeat(F.pow(F.lit(2.0), F.floor(F.log2(most))), F.size(v)), lambda x, y: x / y)


def place(classes: DataFrame, cosine: float = COSINE, even: int = EVEN) -> DataFrame:
    """The blocks of each class (id, label, scaled vector s): home cell, cells that its ball meets, coordinates."""
    sizes = classes.groupBy("label", F.size("s").alias("n")).agg(F.count("*").alias("count"))
    dims = LEAST + F.floor(F.log(F.col("count") / even) / F.log(F.lit(3.0)) + 1)
    dims = F.least(F.lit(BLOCK), F.greatest(F.lit(LEAST), dims)).cast("int").alias("dims")
    own = classes.select("id", "label", "s", F.size("s").alias("n")).join(sizes, ["label", "n"]).select("id", "s", dims)
    return own.mapInArrow(_placed(cosine), _PLACED).join(classes.select("id", "label"), "id")


def meetings(placed: DataFrame) -> DataFrame:
    """Pairs (a, b, near), a < b, once for each cell where a is at home and b looks into; near: within the block's budget."""
    at_home = placed.select("label", F.col("home").alias("cell"), F.col("id").alias("a"), *(f"x{i}" for i in range(BLOCK)))
    looking = placed.select("label", F.explode("met").alias("cell"), F.col("id").alias("b"), "budget", *(F.col(f"x{i}").alias(f"y{i}") for i in range(BLOCK)))
    apart = " + ".join(f"(x{i} - y{i}) * (x{i} - y{i})" for i in range(BLOCK))
    return at_home.join(looking, ["label", "cell"]).where("a < b").select("a", "b", F.expr(f"{apart} <= budget").alias("near"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, even: int = EVEN) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors.

    Only rows with equal labels, neither null, and equally many dimensions are compared. A vector that is null, empty
    or zero, or holds null or non-finite components, links with nothing and is its own component. Repeated rows are
    vectors of their own: they come back as often and count as links. An empty table gives no rows; other columns are
    not read.
    """
    scratch = Scratch(vectors.sparkSession)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    fit = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    own = scratch.keep(own.withColumn("fit", F.coalesce(fit, F.lit(False))))
    fits = own.where("fit").withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # no negative zeros
    classes = fits.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"))
    classes = scratch.keep(classes.select("*", scaled("v").alias("s")))
    placed = scratch.keep(place(classes, cosine, even))
    met = meetings(placed)
    pairs = scratch.keep(met.where("near").select("a", "b").distinct())
    scratch.drop(placed)
    left = classes.select(F.col("id").alias("a"), F.col("s").alias("va"), F.col("size").alias("na"))
    right = classes.select(F.col("id").alias("b"), F.col("s").alias("vb"), F.col("size").alias("nb"))
    links = pairs.join(left, "a").join(right, "b").where(cosine_of("va", "vb") >= cosine)
    links = scratch.keep(links.select("a", "b", "na", "nb"))
    scratch.drop(pairs)
    counts = links.select(F.col("a").alias("id"), F.col("nb").alias("n")).union(links.select("b", "na")).groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    found = classes.join(counts, "id", "left").join(groups, "id", "left")
    found = scratch.keep(found.select("label", "v", F.coalesce("n", F.lit(0)).alias("n"), "size", F.coalesce("component", "id").alias("component")))
    scratch.drop(links, classes)
    linked = fits.select("vec_id", "label", "v").join(found, ["label", "v"])
    out = linked.select("vec_id", (F.col("n") + F.col("size") - 1).cast("long").alias("n_links"), F.col("component").alias("component_id"))
    out = out.union(own.where("not fit").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLE_SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
f AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
      AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
r AS (SELECT vec_id AS id, vec_id AS root FROM e UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
