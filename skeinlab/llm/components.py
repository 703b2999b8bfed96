"""Connected components of an edge table by alternating stars.

Every round links each node's larger neighbours to its least neighbour (large star) and then its
smaller ones (small star), until nothing changes; what is left are stars around each component's
least node. Only minima by node and plain joins are used, so a node with very many neighbours is
no hot group: the minima are keyed by the negated node, so the join deals its rows out anew and Spark
can split a large partition. Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlab.storage import drop_table, write_table


def connected_components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """node and component (its least node) of every node of edges (a, b: long). Self-links are allowed; an empty table gives none."""
    now = write_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    before = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")).select((-F.col("a")).alias("minus"), "m")
        large = both.join(least, -F.col("a") == F.col("minus")).filter("b >= a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.filter("b < a")
        low = down.groupBy("a").agg(F.min("b").alias("m")).select((-F.col("a")).alias("minus"), "m")
        small = down.join(low, -F.col("a") == F.col("minus")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(-F.col("minus"), "m")).filter("a <> b").distinct()
        following = write_table(small, f"{name}-round")
        mark = following.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_table(now)
        now = following
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("the components did not settle")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
    stars._skeinlab_path = now._skeinlab_path  # for drop_table()
    return stars
