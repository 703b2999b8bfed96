"""Distances and neighbourhoods.

Pairs of points are formed by an equi-join on pairs of blocks of vertices, whose number follows from the
space's size, so one large space is dealt out over many tasks. Euclidean edges come from the kernels of ``tiles``, which give the
same distances; with a radius and few coordinates, points meet by grid cells, and far pairs are never formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlab.operators import tiles
from skeinlab.plans.blocks import with_blocks


def square_distance(x: Column, y: Column) -> Column:
    """Sum of squared differences over the shorter length."""
    n = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t)


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(square_distance(x, y))


def pairs(points: DataFrame, blocks: int | None = None) -> DataFrame:
    """space_id, src, dst with src < dst, and x, y, whatever else the two points have (as structs). Each pair once."""
    others = [c for c in points.columns if c not in ("space_id", "v")]
    named = points.select("space_id", "v", F.struct(*others).alias("p") if others else F.lit(None).alias("p"))
    rows = with_blocks(named, blocks)
    left = rows.select(F.col("space_id").alias("s"), F.col("v").alias("v1"), F.col("p").alias("p1"), F.col("b").alias("i"), F.explode(F.sequence(F.col("b"), F.col("nb") - 1)).alias("j"))
    right = rows.select(F.col("space_id").alias("s2"), F.col("v").alias("v2"), F.col("p").alias("p2"), F.col("b").alias("j2"), F.explode(F.sequence(F.lit(0), F.col("b"))).alias("i2"))
    met = left.join(right, (F.col("s") == F.col("s2")) & (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2")) & ((F.col("i") != F.col("j")) | (F.col("v1") < F.col("v2"))))
    up = F.col("v1") < F.col("v2")
    return met.select(F.col("s").alias("space_id"), F.least("v1", "v2").alias("src"), F.greatest("v1", "v2").alias("dst"), F.when(up, F.col("p1")).otherwise(F.col("p2")).alias("x"), F.when(up, F.col("p2")).otherwise(F.col("p1")).alias("y"))


def distances(points: DataFrame, metric=euclidean, blocks: int | None = None) -> DataFrame:
    """space_id, src, dst, d of all pairs. metric takes the two coordinate columns (for spaces without coords: the vertices)."""
    if "coords" in points.columns:
        return pairs(points, blocks).select("space_id", "src", "dst", metric(F.col("x.coords"), F.col("y.coords")).alias("d"))
    return pairs(points, blocks).select("space_id", "src", "dst", metric(F.col("src"), F.col("dst")).alias("d"))


def edges(points: DataFrame, max_f: float = float("inf"), inclusive: bool = False, metric=euclidean, blocks: int | None = None, grid_dims: int = 0) -> DataFrame:
    """distances() below max_f (inclusive: up to it)."""
    if metric is euclidean and blocks is None and not grid_dims and "coords" in points.columns:
        return tiles.edges(points, max_f, inclusive)
    d = within(points, max_f, grid_dims) if grid_dims and max_f < float("inf") else distances(points, metric, blocks)
    return d.filter(F.col("d") <= max_f) if inclusive else d.filter(F.col("d") < max_f)


def within(points: DataFrame, radius: float, dims: int = 2) -> DataFrame:
    """Pairs at most radius apart: a point meets those of its grid cell and the cells next to it in the first dims coordinates."""
    return tiles.edges_by_grid(points, radius, dims)


def both_ways(distances: DataFrame) -> DataFrame:
    return distances.select("space_id", "src", "dst", "d").union(distances.select("space_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "d"))


def elements(points: DataFrame) -> DataFrame:
    return points.select("space_id", "v")


def sizes(points: DataFrame) -> DataFrame:
    return points.groupBy("space_id").agg(F.count("*").alias("n"))


def contained(points: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of asked (space_id, v) that are vertices."""
    return asked.join(points.select("space_id", "v"), ["space_id", "v"], "left_semi")


def minimum_enclosing_radius(distances: DataFrame) -> DataFrame:
    """space_id and r: the least over the vertices of the largest distance from one."""
    return both_ways(distances).groupBy("space_id", "src").agg(F.max("d").alias("r")).groupBy("space_id").agg(F.min("r").alias("r"))


def neighbours(points: DataFrame, distances: DataFrame, eps: float) -> DataFrame:
    """space_id, v, w of all pairs at most eps apart; a vertex is its own neighbour."""
    return both_ways(distances.filter(F.col("d") <= eps)).select("space_id", F.col("src").alias("v"), F.col("dst").alias("w")).union(points.select("space_id", "v", "v"))


def neighbours_of(queries: DataFrame, points: DataFrame, eps: float) -> DataFrame:
    """query, space_id and v of the points at most eps from each query (query, space_id, coords)."""
    return tiles.neighbours(queries, points, eps)
