"""Metric spaces: points(space_id, v, coords) or distances(space_id, src, dst, d) with src < dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def explicit(spark: SparkSession, matrix: list[list[float]], space_id: int = 0) -> DataFrame:
    """Distances of a matrix, its places being the vertices."""
    one = spark.createDataFrame([(space_id, [[float(x) for x in row] for row in matrix])], "space_id long, m array<array<double>>")
    rows = one.select("space_id", F.posexplode("m").alias("src", "row")).select("space_id", "src", F.posexplode("row").alias("dst", "d"))
    return rows.filter("src < dst").select("space_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "d")


def euclidean(rows: DataFrame, v: Column, coords: Column, space_id: Column | None = None) -> DataFrame:
    """Points of a table, coordinates as doubles."""
    space = F.lit(0).cast("long") if space_id is None else space_id.cast("long")
    return rows.select(space.alias("space_id"), v.cast("long").alias("v"), coords.cast("array<double>").alias("coords"))


def hypercube(spark: SparkSession, n: int) -> DataFrame:
    """The 2^n vertices of a cube as numbers; see hamming()."""
    return spark.range(1 << n).select(F.lit(0).cast("long").alias("space_id"), F.col("id").alias("v"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("double")


def sparse(distances: DataFrame, diameter: float) -> DataFrame:
    """Distances beyond the diameter are infinite."""
    return distances.withColumn("d", F.when(F.col("d") > diameter, F.lit(float("inf"))).otherwise(F.col("d")))


def neighbourhoods(distances: DataFrame, diameter: float) -> DataFrame:
    """space_id, v and the vertices within the diameter with their distances, nearest first."""
    near = distances.filter(F.col("d") <= diameter)
    both = near.select("space_id", F.col("src").alias("v"), F.struct("d", F.col("dst").alias("w")).alias("n")).union(near.select("space_id", "dst", F.struct("d", F.col("src").alias("w"))))
    return both.groupBy("space_id", "v").agg(F.array_sort(F.collect_list("n")).alias("neighbours"))
