"""Filtered complexes given cell by cell: cells(space_id, cell, dim, f)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlab.functions.simplex import dimension, from_array

SCHEMA = "space_id long, cell array<long>, dim int, f double"


class ExplicitBuilder:
    """Gathers (value, simplex) pairs in any order; result() has them in filtration order."""

    def __init__(self) -> None:
        self.pairs: list[tuple[float, list[int]]] = []

    def add(self, f: float, simplex: Iterable[int]) -> ExplicitBuilder:
        self.pairs.append((float(f), sorted(set(simplex))))
        return self

    def add_all(self, pairs: Iterable[tuple[float, Iterable[int]]]) -> ExplicitBuilder:
        for f, simplex in pairs:
            self.add(f, simplex)
        return self

    def clear(self) -> None:
        self.pairs = []

    def result(self, spark: SparkSession, space_id: int = 0) -> DataFrame:
        return in_order(spark.createDataFrame([(space_id, c, len(c) - 1, f) for f, c in self.pairs], SCHEMA))


def from_table(rows: DataFrame) -> DataFrame:
    """cells of a table (space_id, vertices, f)."""
    cell = from_array(F.col("vertices").cast("array<long>"))
    return rows.select(F.col("space_id").cast("long").alias("space_id"), cell.alias("cell"), dimension(cell).alias("dim"), F.col("f").cast("double").alias("f"))


def in_order(cells: DataFrame) -> DataFrame:
    return cells.orderBy("space_id", "f", "dim", "cell")


def at(cells: DataFrame, i: int) -> DataFrame:
    """The i-th cell (from 0) in filtration order of each space, with that place."""
    from pyspark.sql import Window

    w = Window.partitionBy("space_id").orderBy("f", "dim", "cell")
    return cells.withColumn("place", F.row_number().over(w) - 1).filter(F.col("place") == i)


def strata(cells: DataFrame, max_dim: int) -> dict[int, DataFrame]:
    return {d: cells.filter(F.col("dim") == d) for d in range(max_dim + 1)}


def concatenated(parts: dict[int, DataFrame]) -> DataFrame:
    out = None
    for _, part in sorted(parts.items()):
        out = part if out is None else out.unionByName(part)
    return out


def with_diameter(cells: DataFrame, distances: DataFrame) -> DataFrame:
    """cells(space_id, cell) with dim and f, the largest distance between their vertices; 0 for a vertex."""
    pairs = cells.select("space_id", "cell", F.explode("cell").alias("a")).select("space_id", "cell", "a", F.explode("cell").alias("b")).filter("a < b")
    edges = distances.select(F.col("space_id").alias("_s"), "src", "dst", "d")
    longest = pairs.join(edges, (F.col("space_id") == F.col("_s")) & (F.col("a") == F.col("src")) & (F.col("b") == F.col("dst"))).groupBy("space_id", "cell").agg(F.max("d").alias("f"))
    return cells.select("space_id", "cell").join(longest, ["space_id", "cell"], "left").select("space_id", "cell", dimension(F.col("cell")).alias("dim"), F.coalesce("f", F.lit(0.0)).alias("f"))
