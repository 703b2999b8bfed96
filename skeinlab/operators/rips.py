"""Vietoris-Rips complexes by prefix joins.

Two k-simplices that agree but for their last vertices, with an edge between these, make each
(k+1)-simplex exactly once. It is an equi-join on the prefix and one on the edge; the value is the
greatest of three. ``max_f`` bounds the edges, ``inclusive`` tells whether an edge of that length is in.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlab.functions import simplex as S
from skeinlab.operators import chains, tiles
from skeinlab.operators import metric as M
from skeinlab.sources.cells import at, concatenated


def vertices(points: DataFrame) -> DataFrame:
    return points.select("space_id", F.array("v").alias("cell"), F.lit(0).alias("dim"), F.lit(0.0).alias("f"))


def expand(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """The cliques one dimension up."""
    k = F.size("cell")
    left = cells.select("space_id", "cell", "f", F.slice("cell", F.lit(1), k - 1).alias("prefix"), F.element_at("cell", -1).alias("a"))
    right = cells.select(F.col("space_id").alias("s2"), F.slice("cell", F.lit(1), k - 1).alias("p2"), F.element_at("cell", -1).alias("b"), F.col("f").alias("f2"))
    met = left.join(right, (F.col("space_id") == F.col("s2")) & (F.col("prefix") == F.col("p2")) & (F.col("a") < F.col("b")))
    e = edges.select(F.col("space_id").alias("s3"), F.col("src").alias("e1"), F.col("dst").alias("e2"), "d")
    met = met.join(e, (F.col("space_id") == F.col("s3")) & (F.col("a") == F.col("e1")) & (F.col("b") == F.col("e2")))
    cell = F.concat("cell", F.array("b"))
    return met.select("space_id", cell.alias("cell"), (F.size(cell) - 1).alias("dim"), F.greatest("f", "f2", "d").alias("f"))


def stratified(points: DataFrame, edges: DataFrame, max_dim: int = 2, keep: Callable[[Column], Column] | None = None) -> dict[int, DataFrame]:
    """Cells of each dimension up to max_dim. keep takes a cell column; what it refuses is left out of the result, not of the growth."""
    parts = {0: vertices(points)}
    if max_dim >= 1:
        parts[1] = edges.select("space_id", F.array("src", "dst").alias("cell"), F.lit(1).alias("dim"), F.col("d").alias("f"))
    for d in range(2, max_dim + 1):
        parts[d] = expand(parts[d - 1], edges)
    return {d: p.filter(keep(F.col("cell"))) if keep else p for d, p in parts.items()}


def vietoris_rips(points: DataFrame, max_f: float = float("inf"), max_dim: int = 2, inclusive: bool = False, metric=M.euclidean, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """cells(space_id, cell, dim, f). All clique finders give this set; sort by (f, dim, cell) for their order."""
    return concatenated(stratified(points, M.edges(points, max_f, inclusive, metric), max_dim, keep))


def triangles(points: DataFrame, max_f: float, valued: bool = True, of_edge: dict[str, Column] | None = None) -> DataFrame:
    """space_id, src, dst, w (ascending) and f (only if valued) of each triangle of vietoris_rips(), from kernels over triples of blocks.

    of_edge: more columns of src and dst, worked out once for an edge and not for each of its triangles.
    """
    more = of_edge or {}
    edges = tiles.triangles(points, max_f, valued).withColumns(more) if more else tiles.triangles(points, max_f, valued)
    named = ["space_id", "src", "dst", *more]
    if not valued:
        return edges.select(*named, F.explode("ws").alias("w"))
    return edges.select(*named, "fs", F.posexplode("ws").alias("at", "w")).select(*named, "w", F.get("fs", F.col("at")).alias("f"))


def boundary_twice(points: DataFrame, max_f: float, boundary: Callable[[list[chains.Term]], list[chains.Term]] = chains.faces_of) -> DataFrame:
    """n: how many terms the boundaries of the boundaries of all triangles of vietoris_rips() have, each triangle a chain with coefficient 1."""

    def terms(*triangle: np.ndarray) -> int:
        return chains.count_terms(boundary(boundary([(triangle, 1)])))

    return tiles.over_triangles(points, max_f, terms).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"))


def cut_at_radius(points: DataFrame, max_dim: int = 2) -> DataFrame:
    """The complex up to the minimum enclosing radius of each space, beyond which it is a cone."""
    d = M.distances(points)
    r = M.minimum_enclosing_radius(d).withColumnRenamed("space_id", "s")
    edges = d.join(r, F.col("space_id") == F.col("s")).filter("d <= r").select("space_id", "src", "dst", "d")
    return concatenated(stratified(points, edges, max_dim))


def relabelled(points: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Points whose vertices are numbers from 0 in the order of a label, and the dictionary (space_id, v, label)."""
    from pyspark.sql import Window

    numbered = points.withColumn("v", (F.dense_rank().over(Window.partitionBy("space_id").orderBy(label)) - 1).cast("long"))
    return numbered.drop(label), numbered.select("space_id", "v", label).distinct()


def apparent_pairs(cells: DataFrame) -> DataFrame:
    """space_id, birth cell and death cell: the death's latest facet is the birth, and the birth's earliest cofacet is the death."""
    key = F.struct("f", "dim", "cell")
    faces = cells.filter("dim > 0").select("space_id", key.alias("death"), F.explode(S.boundary(F.col("cell"))["face"]).alias("face"))
    own = cells.select(F.col("space_id").alias("s"), F.col("cell").alias("c"), key.alias("birth"))
    incidence = faces.join(own, (F.col("space_id") == F.col("s")) & (F.col("face") == F.col("c"))).select("space_id", "birth", "death")
    latest = incidence.groupBy("space_id", "death").agg(F.max("birth").alias("birth"))
    earliest = incidence.groupBy("space_id", "birth").agg(F.min("death").alias("death"))
    return latest.join(earliest, ["space_id", "birth", "death"]).select("space_id", "birth", "death")


def apparent_pairs_of_points(points: DataFrame, max_f: float) -> DataFrame:
    """apparent_pairs() of the complex up to dimension 2, whose triangles are never made. A vertex's edge: its earliest, if it is the later end."""

    def key(f: Column, *cell: str) -> Column:
        return F.struct(f.alias("f"), F.lit(len(cell) - 1).alias("dim"), F.array_sort(F.array(*cell)).alias("cell"))

    found = tiles.apparent_triangles(points, max_f)
    low = found.filter("w IS NULL").select("space_id", key(F.lit(0.0), "dst").alias("birth"), key(F.col("d"), "src", "dst").alias("death"))
    high = found.filter("w IS NOT NULL").select("space_id", key(F.col("d"), "src", "dst").alias("birth"), key(F.col("d"), "src", "dst", "w").alias("death"))
    return low.unionByName(high)


def zero_pivots(cells: DataFrame, n: int) -> DataFrame:
    """cells with their indices of: zero-pivot cofacet (largest top cofacet of the same value), zero-pivot facet, and zero-apparent cofacet and facet."""
    own = cells.select("space_id", "cell", "dim", "f", S.index(F.col("cell")).alias("idx"))
    face = F.explode(S.boundary(F.col("cell"))["face"]).alias("face")
    up = own.filter("dim > 0").select("space_id", F.col("idx").alias("ci"), F.col("f").alias("cf"), F.col("cell").alias("cc"), face)
    low = own.select(F.col("space_id").alias("s"), F.col("cell").alias("c"), F.col("idx").alias("fi"), F.col("f").alias("ff"))
    pairs = up.join(low, (F.col("space_id") == F.col("s")) & (F.col("face") == F.col("c"))).filter("cf = ff")
    dim = F.size("c") - 1
    cofacet = pairs.filter(F.element_at("cc", -1) > F.element_at("c", -1)).groupBy("space_id", dim.alias("dim"), F.col("fi").alias("idx")).agg(F.max("ci").alias("pivot_cofacet"))
    facet = pairs.groupBy("space_id", (F.size("cc") - 1).alias("dim"), F.col("ci").alias("idx")).agg(F.max("fi").alias("pivot_facet"))
    back = facet.select("space_id", (F.col("dim") - 1).alias("dim"), F.col("pivot_facet").alias("idx"), F.col("idx").alias("pivot_cofacet"))
    apparent = cofacet.join(back, ["space_id", "dim", "idx", "pivot_cofacet"]).select("space_id", "dim", "idx", F.col("pivot_cofacet").alias("apparent_cofacet"))
    down = apparent.select("space_id", (F.col("dim") + 1).alias("dim"), F.col("apparent_cofacet").alias("idx"), F.col("idx").alias("apparent_facet"))
    keys = ["space_id", "dim", "idx"]
    return own.join(cofacet, keys, "left").join(facet, keys, "left").join(apparent, keys, "left").join(down, keys, "left")


def without_apparent(cells: DataFrame) -> DataFrame:
    """The sparse complex: cells of no apparent pair."""
    pairs = apparent_pairs(cells)
    gone = pairs.select("space_id", F.col("birth.cell").alias("cell")).union(pairs.select("space_id", "death.cell"))
    return cells.join(gone, ["space_id", "cell"], "left_anti")


def f_vector(cells: DataFrame) -> DataFrame:
    return cells.groupBy("space_id", "dim").agg(F.count("*").alias("n"))


def euler_characteristic(cells: DataFrame) -> DataFrame:
    return cells.groupBy("space_id").agg(F.sum(F.when(F.col("dim") % 2 == 0, 1).otherwise(-1)).alias("chi"))


def _counts(points: DataFrame, *upper: DataFrame) -> DataFrame:
    """f_vector() of the points and of tables (space_id, n) for each dimension above."""
    parts = [points.groupBy("space_id").agg(F.count("*").alias("n")), *upper]
    named = [p.select("space_id", F.lit(k).alias("dim"), "n") for k, p in enumerate(parts)]
    return concatenated(dict(enumerate(named))).filter("n > 0")


def f_vector_of_points(points: DataFrame, max_f: float) -> DataFrame:
    """f_vector() of the complex up to dimension 2, whose cells are counted and never made."""
    return _counts(points, tiles.count_edges(points, max_f), tiles.count_triangles(points, max_f))


def euler_of_points(points: DataFrame, max_f: float) -> DataFrame:
    n = f_vector_of_points(points, max_f)
    return n.groupBy("space_id").agg(F.sum(F.when(F.col("dim") % 2 == 0, F.col("n")).otherwise(-F.col("n"))).alias("chi"))


def f_vector_at_radius(points: DataFrame) -> DataFrame:
    """f_vector() of cut_at_radius() up to dimension 1, by two passes over the tiles."""
    r = tiles.farthest(points).groupBy("space_id").agg(F.min("m").alias("r"))
    return _counts(points, tiles.count_up_to(points, r))


def cell_at(points: DataFrame, max_f: float, i: int) -> DataFrame:
    """The i-th cell (from 0) in filtration order of each space's complex up to dimension 2, with that place.

    The first i + 1 vertices and edges bound the value of that cell, so only edges up to there, ties included, are expanded.
    """
    edges = tiles.edges(points, max_f, least=i + 1)
    values = edges.select("space_id", F.col("d").alias("f")).unionByName(points.select("space_id", F.lit(0.0).alias("f")))
    bound = at(values.withColumns({"dim": F.lit(0), "cell": F.lit(0)}), i).select(F.col("space_id").alias("_s"), F.col("f").alias("bound"))
    near = edges.join(bound, F.col("space_id") == F.col("_s"), "left").filter("bound IS NULL OR d <= bound").select("space_id", "src", "dst", "d")
    return at(concatenated(stratified(points, near, 2)), i)


def gabriel(points: DataFrame, max_dim: int = 2, own_vertices: str = "ignore") -> DataFrame:
    """Cells whose smallest enclosing ball has no point strictly inside; f is the diameter.

    own_vertices='ignore' leaves the cell's own vertices out of that test, 'count' doesn't (an edge's lie on its ball). Dimension 1 is
    a kernel over blocks of vertices, with the distances of its space a few rows at a time; from dimension 2 an Arrow kernel finds the balls.
    """
    parts = {0: vertices(points), 1: gabriel_edges(points)}
    full = stratified(points, M.distances(points), max_dim) if max_dim > 1 else {}
    for k in range(2, max_dim + 1):
        corner = points.select(F.col("space_id").alias("s1"), F.col("v").alias("v1"), F.col("coords").alias("x"))
        corners = full[k].select("*", F.explode("cell").alias("w")).join(corner, (F.col("space_id") == F.col("s1")) & (F.col("w") == F.col("v1"))).groupBy("space_id", "cell", "dim", "f").agg(F.collect_list("x").alias("corners"))
        parts[k] = _empty(corners.select("space_id", "cell", "dim", "f", _ball("corners").alias("b")).select("space_id", "cell", "dim", "f", "b.centre", "b.radius"), points, own_vertices)
    return concatenated(parts)


def gabriel_edges(points: DataFrame, block: int = 256) -> DataFrame:
    """The edges of gabriel(): a point c is inside the ball of ab if |ac|^2 + |bc|^2 is less than |ab|^2.

    Such a c is nearer to a or to b than |ab| / sqrt(2), so the few points near an end are tried alone. A block of vertices of a space is a
    task that holds the space's coordinates. Squared distances come from a matrix product, and again one by one where its error matters.
    """
    import numpy as np
    import pyarrow as pa

    dealt = tiles._blocks(tiles._own(points), block).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    shrunk = (1 - 1e-9) ** 2

    def each(rows: pa.Table) -> pa.Table:
        own = tiles.side(rows)
        own = own.of(np.unique(own.v, return_index=True)[1])
        v, x, n = own.v, own.x, len(own.v)
        norms = (x**2).sum(0)
        slack = 1e-15 * (len(x) + 100) * (2 * norms.max() + 1)

        def squares(which: np.ndarray) -> np.ndarray:
            g = x[:, which].T @ x
            g *= -2
            g += norms[which][:, None]
            g += norms
            return np.maximum(g, 0, out=g)

        def exact(i: int, j: int) -> float:
            return float(((x[:, i] - x[:, j]) ** 2).sum())

        def kept(i: int, js: np.ndarray, q: np.ndarray, from_i: np.ndarray, from_j: np.ndarray, alive: np.ndarray) -> None:
            """Takes from alive the js with a point near i in their ball. q: |ij|^2; from_j: rows of js."""
            near = np.flatnonzero(from_i < q.max(initial=0) / 2 + slack)
            near = near[near != i]
            middle = np.partition(q, int(0.9 * len(q)))[int(0.9 * len(q))] / 2
            close = from_i[near] < middle
            for cs, far in ((near[close], False), (near[~close], True)):
                at = np.flatnonzero(alive & (q > 2 * middle - 4 * slack)) if far else np.flatnonzero(alive)
                if not len(cs) or not len(at):
                    continue
                both = from_j[np.ix_(at, cs)] + from_i[cs]
                both -= (q[at] * ((1 + shrunk) / 2))[:, None]  # (|ac|^2 + |bc|^2) / 2 - |ab|^2 / 4 < |ab|^2 / 4 * shrunk
                both[js[at][:, None] == cs] = np.inf
                gone = (both < -4 * slack).any(1)
                rest = np.flatnonzero(~gone)
                for k, c in zip(*np.nonzero(np.abs(both[rest]) <= 4 * slack), strict=True):
                    j, c = int(js[at[rest[k]]]), int(cs[c])
                    quarter = exact(i, j) / 4
                    if (exact(i, c) + exact(j, c)) / 2 - quarter < quarter * shrunk:
                        gone[rest[k]] = True
                alive[at[gone]] = False

        mine = np.arange(rows.column("o")[0].as_py(), n, rows.column("nb")[0].as_py())
        from_mine = squares(mine)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for lo in range(0, n, block):
            js = np.arange(lo, min(lo + block, n))
            from_js = squares(js)
            alive = mine[:, None] < js
            for k, i in enumerate(mine.tolist()):
                if alive[k].any():
                    kept(i, js, from_mine[k, js], from_mine[k], from_js, alive[k])
            for k, j in enumerate(js.tolist()):
                if alive[:, k].any():
                    kept(j, mine, from_js[k, mine], from_js[k], from_mine, alive[:, k])
            a, b = np.nonzero(alive)
            found.append((mine[a], js[b]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        length = tiles._at(own, own, i, j)
        cells = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(i) + 1, 2), pa.int32()), pa.array(np.stack((v[i], v[j]), 1).ravel(), pa.int64()))
        space = pa.array([rows.column("space_id")[0].as_py()] * len(i), pa.int64())
        return pa.table([space, cells, pa.array(np.ones(len(i), np.int32)), length], ["space_id", "cell", "dim", "f"])

    return dealt.select("space_id", "o", "nb", "v", "coords").groupBy("space_id", "o").applyInArrow(each, "space_id long, cell array<long>, dim int, f double")


def _empty(balls: DataFrame, points: DataFrame, own_vertices: str) -> DataFrame:
    p = points.select(F.col("space_id").alias("_s"), F.col("v").alias("_v"), F.col("coords").alias("_x"))
    inside = M.euclidean(F.col("centre"), F.col("_x")) < F.col("radius") * (1 - 1e-9)
    own = ~F.array_contains("cell", F.col("_v")) if own_vertices == "ignore" else F.lit(True)
    return balls.join(p, (F.col("space_id") == F.col("_s")) & inside & own, "left_anti").select("space_id", "cell", "dim", "f")


def _ball(name: str) -> Column:
    @F.pandas_udf("centre array<double>, radius double")
    def ball(corners: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([smallest_ball([list(x) for x in c]) for c in corners], columns=["centre", "radius"])

    return ball(F.col(name))


def smallest_ball(corners: list[list[float]]) -> tuple[list[float], float]:
    """The least ball around a few points: the least circumscribed ball of a subset that holds them all."""
    import itertools

    import numpy as np

    pts = np.array(corners, float)
    best = None
    for k in range(1, len(pts) + 1):
        for which in itertools.combinations(range(len(pts)), k):
            base, rest = pts[which[0]], pts[list(which[1:])] - pts[which[0]]
            if len(rest):
                if np.linalg.matrix_rank(rest) < len(rest):
                    continue
                offset = np.linalg.lstsq(2 * rest @ rest.T, (rest**2).sum(1), rcond=None)[0] @ rest
            else:
                offset = np.zeros_like(base)
            centre, radius = base + offset, float(np.sqrt((offset**2).sum()))
            if (np.sqrt(((pts - centre) ** 2).sum(1)) <= radius * (1 + 1e-9) + 1e-12).all() and (best is None or radius < best[1]):
                best = (centre.tolist(), radius)
    return best
