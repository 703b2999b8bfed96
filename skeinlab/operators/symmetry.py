"""Groups that act on vertices: tables action(g, v, gv)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def permutation(n: int, k: int) -> list[int]:
    """The k-th permutation of 0..n-1 in lexicographic order."""
    rest, out = list(range(n)), []
    for i in range(n - 1, -1, -1):
        at, k = divmod(k, math.factorial(i))
        out.append(rest.pop(at))
    return out


def permutations(spark: SparkSession, n: int) -> DataFrame:
    """g and its permutation, for all n! of them (n up to 9)."""
    if n > 9:
        raise ValueError("too many permutations for one table")
    return spark.createDataFrame([(k, permutation(n, k)) for k in range(math.factorial(n))], "g long, p array<int>")


def _on_bits(perms: DataFrame, n: int) -> DataFrame:
    vertices = perms.sparkSession.range(1 << n).select(F.col("id").alias("v"))
    moved = F.aggregate(F.transform("p", lambda to, i: F.call_function("getbit", F.col("v"), i).cast("long") * F.pow(F.lit(2), to).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return perms.join(F.broadcast(vertices)).select("g", "v", moved.alias("gv"))


def hypercube_action(spark: SparkSession, n: int) -> DataFrame:
    """Permutations of the n bits, on the 2^n vertices of the cube."""
    return _on_bits(permutations(spark, n), n)


def hypercube_generators(spark: SparkSession, n: int) -> DataFrame:
    """The n - 1 swaps of neighbouring bits."""
    rows = [(i, [i + 1 if j == i else i if j == i + 1 else j for j in range(n)]) for i in range(n - 1)]
    return _on_bits(spark.createDataFrame(rows, "g long, p array<int>"), n)


def images(cells: DataFrame, action: DataFrame) -> DataFrame:
    """cells with g and image, the sorted image of each under each group element."""
    keys = cells.columns
    rows = cells.withColumn("_v", F.explode("cell")).join(action.withColumnRenamed("v", "_v"), "_v")
    return rows.groupBy(*keys, "g").agg(F.array_sort(F.collect_set("gv")).alias("image"))


def orbits(cells: DataFrame, action: DataFrame) -> DataFrame:
    """cell and its distinct images."""
    return images(cells.select("cell").distinct(), action).select("cell", "image").distinct()


def representatives(cells: DataFrame, action: DataFrame) -> DataFrame:
    """cell, representative (the least image) and is_representative."""
    rows = orbits(cells, action).groupBy("cell").agg(F.min("image").alias("representative"))
    return rows.withColumn("is_representative", F.col("cell") == F.col("representative"))


def only_representatives(cells: DataFrame, action: DataFrame, generators: DataFrame | None = None) -> DataFrame:
    """The cells that are the least of their orbits; generators sift out most others cheaply before."""
    if generators is not None:
        cells = pseudo_minimal(cells, generators)
    least = representatives(cells, action).filter("is_representative").select("cell")
    return cells.join(least, "cell", "left_semi").select(*cells.columns)


def pseudo_minimal(cells: DataFrame, generators: DataFrame) -> DataFrame:
    """The cells that no generator makes smaller."""
    smaller = images(cells.select("cell").distinct(), generators).filter(F.col("image") < F.col("cell")).select("cell").distinct()
    return cells.join(smaller, "cell", "left_anti").select(*cells.columns)


def expand(representatives: DataFrame, action: DataFrame) -> DataFrame:
    """Every cell of the orbits of representatives (cell, and others that its orbit shares)."""
    others = [c for c in representatives.columns if c != "cell"]
    return images(representatives, action).select(F.col("cell").alias("representative"), F.col("image").alias("cell"), *others).distinct()


def orbit_ranges(representatives: DataFrame, action: DataFrame) -> DataFrame:
    """cell, size of its orbit, and start: the place of the orbit's first cell in the expanded list.

    Orbits are numbered within groups of one first vertex; only the groups' totals meet in one window.
    """
    sizes = orbits(representatives, action).groupBy("cell").agg(F.count("*").alias("size")).withColumn("g", F.get("cell", F.lit(0)))
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("g").agg(F.sum("size").alias("size")).select(F.col("g").alias("_g"), before(Window.orderBy("g")).alias("_start"))
    rows = sizes.join(groups, F.col("g").eqNullSafe(F.col("_g")))
    return rows.select("cell", "size", (F.col("_start") + before(Window.partitionBy("g").orderBy("cell"))).alias("start"))


def element(representatives: DataFrame, action: DataFrame, i: int) -> DataFrame:
    """The i-th cell of the expanded list; an orbit is in ascending order."""
    at = orbit_ranges(representatives, action).filter((F.col("start") <= i) & (i < F.col("start") + F.col("size")))
    own = orbits(at.select("cell"), action)
    ordered = own.groupBy("cell").agg(F.array_sort(F.collect_list("image")).alias("all")).join(at, "cell")
    return ordered.select(F.get("all", (F.lit(i) - F.col("start")).cast("int")).alias("cell"))


def symmetric_cells(cells: DataFrame, action: DataFrame, generators: DataFrame | None = None) -> DataFrame:
    """A symmetric complex from its representatives alone: they are kept, then expanded in filtration order of f."""
    kept = only_representatives(cells, action, generators)
    return expand(kept.select("cell", "space_id", "dim", "f"), action)
