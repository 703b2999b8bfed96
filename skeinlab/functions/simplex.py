"""Simplices as ascending arrays of vertices.

Columns of arrays compare element by element, a prefix first, which is the lexicographic order of
simplices; ``filtered_key`` is the order of a filtration (value, dimension, vertices).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def simplex(*vertices: Column | str) -> Column:
    return from_array(F.array(*vertices))


def from_array(vertices: Column) -> Column:
    return F.array_sort(F.array_distinct(vertices))


def dimension(cell: Column) -> Column:
    """Number of vertices less one; -1 for the empty simplex."""
    return F.size(cell) - 1


def show(cell: Column) -> Column:
    return F.concat(F.lit("∆("), F.array_join(F.transform(cell, lambda v: v.cast("string")), ","), F.lit(")"))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def filtered_key(f: Column, cell: Column) -> Column:
    return F.struct(f.alias("f"), dimension(cell).alias("dim"), cell.alias("cell"))


def boundary(cell: Column) -> Column:
    """array<struct<face, coeff>>: the faces with alternating signs; empty for dimension 0 and less."""
    terms = F.transform(cell, lambda v, i: F.struct(F.filter(cell, lambda w: w != v).alias("face"), F.when(i % 2 == 0, F.lit(1).cast("long")).otherwise(F.lit(-1).cast("long")).alias("coeff")))
    return F.when(F.size(cell) > 1, terms).otherwise(F.filter(terms, lambda x: F.lit(False)))


def sub_simplices(cell: Column) -> Column:
    """All non-empty subsets of a simplex of up to 62 vertices."""
    masks = F.sequence(F.lit(1).cast("long"), F.expr("cast(1 as bigint)") * F.pow(F.lit(2), F.size(cell)).cast("long") - 1)
    return F.transform(masks, lambda m: F.filter(cell, lambda v, i: F.call_function("getbit", m, i) == 1))


def binomial(n: Column, k: Column | int) -> Column:
    """C(n, k) in 64 bits: C(0, 0) = 1, and 0 if k > n or k < 0. Each step divides exactly; an overflow raises an error."""
    k = F.lit(k) if isinstance(k, int) else k
    n, k = n.cast("long"), k.cast("long")
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long")))
    product = F.aggregate(steps, F.lit(1).cast("long"), lambda acc, i: _div(acc * (n - k + i), i))
    return F.when((k < 0) | (k > n), F.lit(0).cast("long")).when(k == 0, F.lit(1).cast("long")).otherwise(product)


def _div(a: Column, b: Column) -> Column:
    """Exact quotient: in decimals, as doubles lose digits beyond 2^53."""
    return (a.cast("decimal(19,0)") / b.cast("decimal(19,0)")).cast("long")


def index(cell: Column) -> Column:
    """Place of a simplex in the combinatorial number system: the sum of C(v_i, i + 1)."""
    return F.aggregate(F.transform(cell, lambda v, i: binomial(v, i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)


def choose(n: Column, k: int) -> Column:
    """binomial() for k of 1, 2 or 3, by products of integers alone."""
    n = n.cast("long")
    value = n if k == 1 else _whole(n * (n - 1), 2) if k == 2 else _whole(_whole(n * (n - 1), 2) * (n - 2), 3)
    return F.when(n < k, F.lit(0).cast("long")).otherwise(value)


def _whole(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def index_of(*vertices: Column) -> Column:
    """index() of a simplex of up to three vertices, given one by one."""
    first, *rest = (choose(v, i + 1) for i, v in enumerate(vertices))
    return sum(rest, first)


def from_index(number: Column, size: int, n: int) -> Column:
    """The simplex of ``size`` of n vertices at a place; each vertex is the largest that still fits."""

    def step(acc: Column, k: Column) -> Column:
        chosen = F.array(_largest(acc["rest"], k, n))
        return F.get(F.transform(chosen, lambda v: F.struct((acc["rest"] - binomial(v, k)).alias("rest"), F.concat(F.array(v), acc["cell"]).alias("cell"))), F.lit(0))

    start = F.struct(number.cast("long").alias("rest"), F.expr("cast(array() as array<bigint>)").alias("cell"))
    return F.aggregate(F.sequence(F.lit(size), F.lit(1), F.lit(-1)), start, step, lambda acc: acc["cell"])


def _largest(rest: Column, k: Column, n: int) -> Column:
    return F.array_max(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda v: binomial(v, k) <= rest))


def facets(cells: DataFrame, cell: str = "cell") -> DataFrame:
    """cells with facet, its coefficient and its index, a row for each."""
    rows = cells.withColumn("_t", F.explode(boundary(F.col(cell))))
    return rows.withColumns({"facet": F.col("_t.face"), "coeff": F.col("_t.coeff"), "facet_index": index(F.col("_t.face"))}).drop("_t")


def cofacets(cells: DataFrame, n: int, top_only: bool = False, cell: str = "cell") -> DataFrame:
    """cells with cofacet and its index, one for each vertex of 0..n-1 outside (top_only: above) the simplex."""
    rows = cells.withColumn("_w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    outside = F.col("_w") > F.element_at(F.col(cell), -1) if top_only else ~F.array_contains(F.col(cell), F.col("_w"))
    rows = rows.filter(outside).withColumn("cofacet", union(F.col(cell), F.array("_w")))
    return rows.withColumn("cofacet_index", index(F.col("cofacet"))).drop("_w")
