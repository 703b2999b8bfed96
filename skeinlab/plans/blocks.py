"""Blocks of a space's vertices.

All pairs of a space of n points are n^2 / 2 rows, made by a join on pairs of blocks. With about sqrt(n) / 2 blocks
each point is copied sqrt(n) / 2 times, there are n / 8 pairs of blocks, and each makes some 4 n rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_blocks(points: DataFrame, blocks: int | None = None) -> DataFrame:
    """points (space_id, v, ...) with nb, the number of blocks of the space, and b, the block of the vertex."""
    if blocks is not None:
        rows = points.withColumn("nb", F.lit(blocks))
    else:
        sizes = points.groupBy(F.col("space_id").alias("_s")).agg(F.ceil(F.sqrt(F.count("*")) / 2).cast("int").alias("nb"))
        rows = points.join(sizes, F.col("space_id") == F.col("_s")).drop("_s")
    return rows.withColumn("b", F.pmod(F.xxhash64("v"), F.col("nb")).cast("int"))
