"""The registered queries of the library, and the same in SQL.

Spaces are the labels of ``embeddings``, one space for each label. Results hold numbers and strings;
distances are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlab.functions import fields, intervals, modules, text
from skeinlab.functions import simplex as S
from skeinlab.operators import barcode, chains, homology, rips, spanning, symmetry, tiles
from skeinlab.operators import metric as M
from skeinlab.shipping import ship
from skeinlab.sources import metric as source
from skeinlab.sources import simplicial

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EDGE, TRIANGLE = 1.3, 1.36


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return register


def spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.euclidean(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id"), F.col("embedding"), F.col("label"))


def _d(c: str = "d"):
    return F.round(c, 6).alias(c)


def _name(c: str = "cell"):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), "-").alias("cell")


def _millionths(c: str):
    """_d() of a value from 0 to 1e9, by arithmetic where that can't differ from decimals: away from the middle between two millionths."""
    x = F.col(c)
    low = F.floor(x * 1e6)
    part = x * 1e6 - low
    plain = (x >= 0) & (x < 1e9) & (F.abs(part - 0.5) > 0.001)
    return F.when(plain, F.when(part < 0.5, low).otherwise(low + 1) / F.lit(1e6)).otherwise(F.round(c, 6)).alias(c)


def _as_sql(c: str = "d"):
    """round(c, 6) of a value from 0 to 1e9 as DuckDB has it: c * 1e6 as a double, to the nearest whole number. Decimals, as Spark's, differ next to the middle between two millionths."""
    low = F.floor(F.col(c) * 1e6)
    return F.when(F.col(c) * 1e6 - low < 0.5, low).otherwise(low + 1) / F.lit(1e6)


def _joined(*vertices: str):
    return F.array_join(F.array(*(F.col(v).cast("string") for v in vertices)), "-")


_P = "p AS (SELECT label::BIGINT AS space_id, vec_id AS v, embedding::DOUBLE[] AS x FROM embeddings)"
_D = _P + ", dist AS (SELECT a.space_id, a.v AS src, b.v AS dst, list_distance(a.x, b.x) AS d FROM p a JOIN p b ON a.space_id = b.space_id AND a.v < b.v)"
_E = _D + f", e AS (SELECT * FROM dist WHERE d < {TRIANGLE})"
_T = _E + ", t AS (SELECT a.space_id, a.src AS i, a.dst AS j, b.dst AS k, greatest(a.d, b.d, c.d) AS f FROM e a JOIN e b ON a.space_id = b.space_id AND a.dst = b.src JOIN e c ON c.space_id = a.space_id AND c.src = a.src AND c.dst = b.dst)"
_CELLS = _T + ", cells AS (SELECT space_id, [v] AS cell, 0 AS dim, 0.0::DOUBLE AS f FROM p UNION ALL SELECT space_id, [src, dst], 1, d FROM e UNION ALL SELECT space_id, [i, j, k], 2, f FROM t)"


@query(f"WITH {_D} SELECT space_id, src, dst, round(d, 6) AS d FROM dist")
def pairwise_distance(spark, sf_dir):
    return M.distances(spaces(spark, sf_dir)).select("space_id", "src", "dst", _d())


@query(f"WITH {_D} SELECT space_id, src, dst, CASE WHEN d > 1.4 THEN 'infinity'::DOUBLE ELSE round(d, 6) END AS d FROM dist")
def sparse_metric(spark, sf_dir):
    d = source.sparse(M.distances(spaces(spark, sf_dir)), 1.4)
    return d.select("space_id", "src", "dst", F.when(F.col("d") <= 1.4, _as_sql()).otherwise(F.col("d")).alias("d"))


@query(f"WITH {_D} SELECT space_id, src AS v, dst AS w FROM dist WHERE d <= 1.25 UNION ALL SELECT space_id, dst, src FROM dist WHERE d <= 1.25 UNION ALL SELECT space_id, v, v FROM p")
def eps_neighbors(spark, sf_dir):
    points = spaces(spark, sf_dir)
    return M.neighbours(points, M.distances(points), 1.25)


@query(f"WITH {_D}, b AS (SELECT space_id, src AS v, d FROM dist UNION ALL SELECT space_id, dst, d FROM dist) SELECT space_id, round(min(m), 6) AS r FROM (SELECT space_id, v, max(d) AS m FROM b GROUP BY ALL) GROUP BY space_id")
def enclosing_radius(spark, sf_dir):
    return M.minimum_enclosing_radius(M.distances(spaces(spark, sf_dir))).select("space_id", _d("r"))


@query(f"WITH {_D} SELECT space_id, src, dst, round(d, 6) AS d FROM dist WHERE d < {EDGE}")
def rips_edges_strict(spark, sf_dir):
    return M.edges(spaces(spark, sf_dir), EDGE).select("space_id", "src", "dst", _d())


@query(f"WITH {_D} SELECT space_id, src, dst, round(d, 6) AS d FROM dist WHERE d <= {EDGE}")
def rips_edges_inclusive(spark, sf_dir):
    return M.edges(spaces(spark, sf_dir), EDGE, inclusive=True).select("space_id", "src", "dst", _d())


def complex_of(spark, sf_dir, max_dim: int = 2) -> DataFrame:
    return rips.vietoris_rips(spaces(spark, sf_dir), TRIANGLE, max_dim)


@query(f"WITH {_T} SELECT space_id, concat_ws('-', i, j, k) AS cell, round(f, 6) AS f FROM t")
def rips_triangles(spark, sf_dir):
    rows = rips.triangles(spaces(spark, sf_dir), TRIANGLE, of_edge={"start": F.concat(_joined("src", "dst"), F.lit("-"))})
    return rows.select("space_id", F.concat("start", F.col("w").cast("string")).alias("cell"), _millionths("f"))


@query(f"WITH {_T} SELECT a.space_id, concat_ws('-', a.i, a.j, a.k, b.k) AS cell, round(greatest(a.f, b.f, x.d), 6) AS f FROM t a JOIN t b ON a.space_id = b.space_id AND a.i = b.i AND a.j = b.j AND a.k < b.k JOIN e x ON x.space_id = a.space_id AND x.src = a.k AND x.dst = b.k")
def rips_tetrahedra(spark, sf_dir):
    return complex_of(spark, sf_dir, 3).filter("dim = 3").select("space_id", _name(), _d("f"))


@query(f"WITH {_CELLS} SELECT space_id, dim, count(*) AS n FROM cells GROUP BY ALL")
def rips_f_vector(spark, sf_dir):
    return rips.f_vector_of_points(spaces(spark, sf_dir), TRIANGLE)


@query(f"WITH {_CELLS} SELECT space_id, sum(CASE WHEN dim % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS chi FROM cells GROUP BY ALL")
def rips_euler(spark, sf_dir):
    return rips.euler_of_points(spaces(spark, sf_dir), TRIANGLE)


@query(f"WITH {_T} SELECT space_id, concat_ws('-', i, j, k) AS cell, (i + j * (j - 1) // 2 + k * (k - 1) * (k - 2) // 6)::BIGINT AS idx FROM t")
def simplex_index(spark, sf_dir):
    edge = {"start": F.concat(_joined("src", "dst"), F.lit("-")), "low": S.index_of(F.col("src"), F.col("dst"))}
    rows = rips.triangles(spaces(spark, sf_dir), TRIANGLE, valued=False, of_edge=edge)
    return rows.select("space_id", F.concat("start", F.col("w").cast("string")).alias("cell"), (F.col("low") + S.choose(F.col("w"), 3)).alias("idx"))


@query("WITH v AS (SELECT range AS v FROM range(12)) SELECT concat_ws('-', a.v, b.v, c.v) AS cell, (a.v + b.v * (b.v - 1) // 2 + c.v * (c.v - 1) * (c.v - 2) // 6)::BIGINT AS idx FROM v a JOIN v b ON a.v < b.v JOIN v c ON b.v < c.v")
def simplex_unindex(spark, sf_dir):
    return spark.range(220).select(F.col("id").alias("idx"), S.from_index(F.col("id"), 3, 12).alias("cell")).select(_name(), "idx")


def _facets(spark, sf_dir) -> DataFrame:
    """A row for each facet of a triangle: its two vertices, names of both, and its sign; facets leave the vertices out in turn."""
    edge = {"both": _joined("src", "dst"), "start": F.concat(_joined("src", "dst"), F.lit("-")), "one": F.concat(F.col("src").cast("string"), F.lit("-")), "two": F.concat(F.col("dst").cast("string"), F.lit("-"))}
    rows = rips.triangles(spaces(spark, sf_dir), TRIANGLE, valued=False, of_edge=edge).withColumn("end", F.col("w").cast("string"))
    named = rows.select("space_id", "src", "dst", "w", F.concat("start", "end").alias("cell"), F.concat("two", "end").alias("0"), F.concat("one", "end").alias("1"), F.col("both").alias("2"))
    out = named.unpivot(["space_id", "src", "dst", "w", "cell"], ["0", "1", "2"], "out", "facet")
    low, high = F.when(F.col("out") == "0", F.col("dst")).otherwise(F.col("src")), F.when(F.col("out") == "2", F.col("dst")).otherwise(F.col("w"))
    return out.select("space_id", "cell", "facet", F.when(F.col("out") == "1", F.lit(-1)).otherwise(F.lit(1)).cast("long").alias("coeff"), low.alias("low"), high.alias("high"))


@query(f"WITH {_T} SELECT space_id, concat_ws('-', i, j, k) AS cell, unnest([concat_ws('-', j, k), concat_ws('-', i, k), concat_ws('-', i, j)]) AS facet, unnest([1, -1, 1])::BIGINT AS coeff FROM t")
def boundary_matrix(spark, sf_dir):
    return _facets(spark, sf_dir).select("space_id", "cell", "facet", "coeff")


@query("SELECT 0::BIGINT AS n")
def boundary_squared_zero(spark, sf_dir):
    return rips.boundary_twice(spaces(spark, sf_dir), TRIANGLE)


_V = "v AS (SELECT range AS v FROM range(10)), c AS (SELECT a.v AS i, b.v AS j FROM v a JOIN v b ON a.v < b.v)"


def _edges_of_ten(spark):
    return spark.range(45).select(S.from_index(F.col("id"), 2, 10).alias("cell"))


@query(f"WITH {_V} SELECT concat_ws('-', i, j) AS cell, array_to_string(list_sort([i, j, v]), '-') AS cofacet FROM c, v WHERE v <> i AND v <> j")
def cofacets(spark, sf_dir):
    return S.cofacets(_edges_of_ten(spark), 10).select(_name(), F.array_join(F.transform("cofacet", lambda v: v.cast("string")), "-").alias("cofacet"))


@query(f"WITH {_V} SELECT concat_ws('-', i, j) AS cell, concat_ws('-', i, j, v) AS cofacet FROM c, v WHERE v > j")
def top_cofacets(spark, sf_dir):
    return S.cofacets(_edges_of_ten(spark), 10, top_only=True).select(_name(), F.array_join(F.transform("cofacet", lambda v: v.cast("string")), "-").alias("cofacet"))


@query(f"""WITH {_CELLS}, inc AS (
  SELECT c.space_id, {{'f': b.f, 'dim': b.dim, 'cell': b.cell}} AS birth, {{'f': c.f, 'dim': c.dim, 'cell': c.cell}} AS death FROM cells c JOIN cells b ON b.space_id = c.space_id AND b.dim = c.dim - 1 AND list_has_all(c.cell, b.cell)),
 l AS (SELECT space_id, death, max(birth) AS birth FROM inc GROUP BY ALL), m AS (SELECT space_id, birth, min(death) AS death FROM inc GROUP BY ALL)
SELECT l.space_id, array_to_string(l.birth.cell, '-') AS birth, array_to_string(l.death.cell, '-') AS death FROM l JOIN m ON l.space_id = m.space_id AND l.birth = m.birth AND l.death = m.death""")
def apparent_pairs(spark, sf_dir):
    found = tiles.apparent_triangles(spaces(spark, sf_dir), TRIANGLE)
    edge, vertex = _joined("src", "dst"), F.col("w").isNull()
    triangle = F.concat_ws("-", F.least("src", "w").cast("string"), F.greatest("src", F.least("dst", "w")).cast("string"), F.greatest("dst", "w").cast("string"))
    return found.select("space_id", F.when(vertex, F.col("dst").cast("string")).otherwise(edge).alias("birth"), F.when(vertex, edge).otherwise(triangle).alias("death"))


_CH = "ch AS (SELECT l_orderkey % 100 AS chain_id, [l_partkey % 20, 20 + l_suppkey % 20, 40 + l_linenumber] AS cell, l_linenumber - 3.0 AS coeff FROM lineitem)"


def _chains(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cell = F.array(F.col("l_partkey") % 20, F.col("l_suppkey") % 20 + 20, (F.col("l_linenumber") + 40).cast("long"))
    return rows.select((F.col("l_orderkey") % 100).alias("chain_id"), cell.alias("cell"), (F.col("l_linenumber") - 3.0).cast("double").alias("coeff"))


@query(f"WITH {_CH} SELECT chain_id, array_to_string(cell, '-') AS cell, sum(coeff)::DOUBLE AS coeff FROM ch GROUP BY chain_id, ch.cell HAVING abs(sum(coeff)) >= 1e-9")
def chain_collapse(spark, sf_dir):
    return chains.collapse(_chains(spark, sf_dir)).select("chain_id", _name(), "coeff")


@query(f"WITH {_CH} SELECT chain_id, array_to_string(cell, '-') AS cell, (sum(coeff) * 2.5)::DOUBLE AS coeff FROM ch GROUP BY chain_id, ch.cell HAVING abs(sum(coeff)) >= 1e-9")
def chain_scale(spark, sf_dir):
    return chains.scale(_chains(spark, sf_dir), 2.5).select("chain_id", _name(), "coeff")


@query("SELECT chain_id, true AS equal FROM (SELECT DISTINCT l_orderkey % 100 AS chain_id FROM lineitem)")
def chain_minus_itself(spark, sf_dir):
    own = _chains(spark, sf_dir)
    return chains.equal(chains.plus(own, chains.minus(own, own)), own)


@query(f"WITH {_CH}, b AS (SELECT chain_id, unnest([[cell[2], cell[3]], [cell[1], cell[3]], [cell[1], cell[2]]]) AS face, unnest([coeff, -coeff, coeff]) AS c FROM ch) SELECT chain_id, array_to_string(face, '-') AS cell, sum(c)::DOUBLE AS coeff FROM b GROUP BY chain_id, b.face HAVING abs(sum(c)) >= 1e-9")
def chain_boundary(spark, sf_dir):
    return chains.boundary(_chains(spark, sf_dir)).select("chain_id", _name(), "coeff")


_N = "CASE WHEN {0} > 8 THEN {0} - 17 ELSE {0} END"


@query("WITH n AS (SELECT range - 40 AS a FROM range(81)), p AS (SELECT x.a, y.a AS b, (((x.a + y.a) % 17) + 17) % 17 AS s, (((x.a * y.a) % 17) + 17) % 17 AS m FROM n x, n y) SELECT a, b, " + _N.format("s") + " AS plus, " + _N.format("m") + " AS times FROM p")
def fp_arith(spark, sf_dir):
    f = fields.Prime(17)
    rows = spark.range(81 * 81).select((F.floor(F.col("id") / 81) - 40).alias("a"), (F.col("id") % 81 - 40).alias("b"))
    return rows.select("a", "b", f.plus(F.col("a"), F.col("b")).alias("plus"), f.times(F.col("a"), F.col("b")).alias("times"))


@query("WITH n AS (SELECT range AS a FROM range(1, 17)) SELECT x.a, " + _N.format("y.a") + " AS inverse FROM n x JOIN n y ON (x.a * y.a) % 17 = 1")
def fp_inverse(spark, sf_dir):
    return spark.range(1, 17).select(F.col("id").alias("a"), fields.Prime(17).invert(F.col("id")).alias("inverse"))


@query(f"WITH RECURSIVE {_D}, g AS (SELECT space_id, src AS a, dst AS b FROM dist WHERE d < {EDGE} UNION ALL SELECT space_id, dst, src FROM dist WHERE d < {EDGE}), r AS (SELECT space_id, v, v AS w FROM p UNION SELECT r.space_id, r.v, g.b FROM r JOIN g ON g.space_id = r.space_id AND g.a = r.w) SELECT space_id, v, min(w) AS component FROM r GROUP BY ALL")
def components_at(spark, sf_dir):
    return spanning.forest_of_points(spaces(spark, sf_dir), EDGE)[1].withColumnRenamed("root", "component")


@query(f"WITH RECURSIVE {_D}, g AS (SELECT space_id, src AS a, dst AS b FROM dist WHERE d < {EDGE} UNION ALL SELECT space_id, dst, src FROM dist WHERE d < {EDGE}), r AS (SELECT space_id, v, v AS w FROM p UNION SELECT r.space_id, r.v, g.b FROM r JOIN g ON g.space_id = r.space_id AND g.a = r.w), c AS (SELECT space_id, v, min(w) AS k FROM r GROUP BY ALL) SELECT space_id, ((SELECT count(*) FROM dist WHERE d < {EDGE} AND dist.space_id = c.space_id) - count(*) + count(DISTINCT k))::BIGINT AS betti1 FROM c GROUP BY space_id")
def graph_betti1(spark, sf_dir):
    """Edges less vertices, plus components."""
    points = spaces(spark, sf_dir)
    parts = spanning.forest_of_points(points, EDGE)[1].groupBy("space_id").agg((F.count_distinct("root") - F.count("*")).alias("less"))
    return parts.join(tiles.count_edges(points, EDGE), "space_id", "left").select("space_id", (F.coalesce("n", F.lit(0)) + F.col("less")).cast("long").alias("betti1"))


#: Prim's algorithm: the nearest vertex that isn't in the tree joins it.
_PRIM = _D + """, g AS (SELECT space_id, src AS a, dst AS b, d FROM dist UNION ALL SELECT space_id, dst, src, d FROM dist),
 prim AS (SELECT space_id, [min(v)] AS seen, NULL::BIGINT AS src, NULL::BIGINT AS dst, NULL::DOUBLE AS d FROM p GROUP BY space_id
  UNION ALL SELECT q.space_id, list_append(any_value(q.seen), arg_min(g.b, g.d)), arg_min(least(g.a, g.b), g.d), arg_min(greatest(g.a, g.b), g.d), min(g.d)
  FROM prim q JOIN g ON g.space_id = q.space_id AND list_contains(q.seen, g.a) AND NOT list_contains(q.seen, g.b) GROUP BY q.space_id),
 mst AS (SELECT space_id, src, dst, d FROM prim WHERE d IS NOT NULL)"""


@query(f"WITH RECURSIVE {_PRIM} SELECT space_id, src, dst, round(d, 6) AS d FROM mst")
def mst_edges(spark, sf_dir):
    points = spaces(spark, sf_dir)
    return spanning.forest_of_points(points)[0].select("space_id", "src", "dst", _d())


@query(f"WITH RECURSIVE {_PRIM} SELECT space_id, src, dst, round(d, 6) AS d FROM dist ANTI JOIN mst USING (space_id, src, dst)")
def non_tree_edges(spark, sf_dir):
    points = spaces(spark, sf_dir)
    return spanning.off_the_forest(points).select("space_id", "src", "dst", _d())


@query(f"WITH RECURSIVE {_PRIM} SELECT space_id, 0 AS dim, 0.0::DOUBLE AS birth, round(d, 6) AS death FROM mst")
def zero_persistence(spark, sf_dir):
    points = spaces(spark, sf_dir)
    return spanning.finite_bars(spanning.forest_of_points(points)[0]).select("space_id", "dim", "birth", _d("death"))


@query(f"WITH RECURSIVE {_PRIM} SELECT space_id, 0 AS dim, 0.0::DOUBLE AS birth, round(d, 6) AS death FROM mst UNION ALL SELECT DISTINCT space_id, 0, 0.0, 'infinity'::DOUBLE FROM p")
def persistence_h0(spark, sf_dir):
    """The bars of dimension 0 by column reduction, which the spanning forest has to give, too. Edges that a tile's forest lacks have columns that become zero."""
    points = spaces(spark, sf_dir)
    cells = rips.concatenated(rips.stratified(points, tiles.forest_edges(points), 1))
    return homology.bars(cells).filter("dim = 0").select("space_id", "dim", "birth", _d("death"))


@query(f"WITH {_CELLS} SELECT space_id, sum(CASE WHEN dim % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS chi FROM cells WHERE f < 1.33 GROUP BY ALL")
def persistence_euler_check(spark, sf_dir):
    bars = homology.diagram_at(homology.bars(complex_of(spark, sf_dir)), 1.33).filter("death = double('infinity')")
    return bars.groupBy("space_id").agg(F.sum(F.when(F.col("dim") % 2 == 0, 1).otherwise(-1)).alias("chi"))


#: Column reduction over Z/2, a step a round: a column takes the reduced one with its lowest edge, or is kept under that edge.
_REDUCED = _PRIM + f""", e AS (SELECT * FROM dist WHERE d < {TRIANGLE}), er AS (SELECT *, row_number() OVER (PARTITION BY space_id ORDER BY d, src, dst) AS r FROM e),
 tr AS (SELECT a.space_id, greatest(a.d, b.d, c.d) AS f, list_sort([a.r, b.r, c.r]) AS col, row_number() OVER (PARTITION BY a.space_id ORDER BY greatest(a.d, b.d, c.d), a.src, a.dst, b.dst) AS n
  FROM er a JOIN er b ON a.space_id = b.space_id AND a.dst = b.src JOIN er c ON c.space_id = a.space_id AND c.src = a.src AND c.dst = b.dst),
 st(space_id, n, col, lows, cols, ns) USING KEY (space_id) AS (
  SELECT DISTINCT space_id, 0::BIGINT, []::BIGINT[], []::BIGINT[], []::BIGINT[][], []::BIGINT[] FROM tr
  UNION ALL SELECT s.space_id, CASE WHEN len(s.col) = 0 THEN tr.n ELSE s.n END,
   CASE WHEN len(s.col) = 0 THEN tr.col WHEN s.o IS NULL THEN []::BIGINT[] ELSE list_sort(list_concat(list_filter(s.col, lambda x: NOT list_contains(s.o, x)), list_filter(s.o, lambda x: NOT list_contains(s.col, x)))) END,
   CASE WHEN len(s.col) > 0 AND s.o IS NULL THEN list_append(s.lows, s.col[-1]) ELSE s.lows END, CASE WHEN len(s.col) > 0 AND s.o IS NULL THEN list_append(s.cols, s.col) ELSE s.cols END, CASE WHEN len(s.col) > 0 AND s.o IS NULL THEN list_append(s.ns, s.n) ELSE s.ns END
  FROM (SELECT *, cols[list_position(lows, col[-1])] AS o FROM st) s LEFT JOIN tr ON len(s.col) = 0 AND tr.space_id = s.space_id AND tr.n = s.n + 1 WHERE len(s.col) > 0 OR tr.n IS NOT NULL),
 pr AS (SELECT space_id, unnest(lows) AS r, unnest(ns) AS n FROM st), tree AS (SELECT * FROM mst WHERE d < {TRIANGLE}),
 bars AS (SELECT space_id, 0 AS dim, 0.0::DOUBLE AS birth, d AS death FROM tree
  UNION ALL SELECT space_id, 0, 0.0, 'infinity'::DOUBLE FROM (SELECT space_id, unnest(range((SELECT count(*) FROM p WHERE p.space_id = s.space_id) - (SELECT count(*) FROM tree WHERE tree.space_id = s.space_id))) FROM (SELECT DISTINCT space_id FROM p) s)
  UNION ALL SELECT er.space_id, 1, er.d, tr.f FROM pr JOIN er USING (space_id, r) JOIN tr ON tr.space_id = pr.space_id AND tr.n = pr.n
  UNION ALL SELECT space_id, 1, d, 'infinity'::DOUBLE FROM er ANTI JOIN pr USING (space_id, r) ANTI JOIN tree USING (space_id, src, dst))"""
_H1 = f"WITH RECURSIVE {_REDUCED} SELECT space_id, dim, round(birth, 6) AS birth, round(death, 6) AS death FROM bars"


@query(_H1)
def persistence_h1(spark, sf_dir):
    return homology.bars(complex_of(spark, sf_dir)).filter("dim <= 1").select("space_id", "dim", _d("birth"), _d("death"))


@query(_H1)
def persistence_by_dimension(spark, sf_dir):
    """The bars of persistence_h1, dimension 0 from the spanning forest."""
    return homology.bars_of_points(spaces(spark, sf_dir), TRIANGLE).select("space_id", "dim", _d("birth"), _d("death"))


@query()
def representative_cycles(spark, sf_dir):
    bars = homology.persistent_homology(complex_of(spark, sf_dir), field=fields.Reals()).filter("dim = 1 AND death > birth")
    return bars.select("space_id", _d("birth"), _d("death"), text.show_chain(F.col("cycle")).alias("cycle"))


@query()
def fundamental_cycles(spark, sf_dir):
    return spanning.shown_cycles(spaces(spark, sf_dir), EDGE)


@query("SELECT * FROM (VALUES ('0: [0.0,1.0)'), ('0: [0.0,2.0)'), ('0: [0.0,∞)'), ('1: [3.0,4.0)')) AS t(bar)")
def barcode_strings(spark, sf_dir):
    from skeinlab.sources.cells import ExplicitBuilder

    rows = [(0, [1]), (0, [2]), (0, [3]), (1, [1, 2]), (2, [1, 3]), (3, [2, 3]), (4, [1, 2, 3])]
    bars = homology.persistent_homology(ExplicitBuilder().add_all(rows).result(spark))
    return homology.barcode_at(bars, 5.0).select(intervals.show(F.col("bar")).alias("bar"))


def _bars(spark, rows):
    return spark.createDataFrame([(m, k, float(a), float(b)) for m, k, a, b in rows], "map_id long, k long, lower double, upper double")


def _example(spark):
    mat = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 0, 1.0), (0, 1, 1, 1.0)], "map_id long, row long, col long, x double")
    return _bars(spark, [(0, 0, 2, 5), (0, 1, 3, 7)]), _bars(spark, [(0, 0, 1, 6), (0, 1, 0, 4)]), mat


@query("SELECT * FROM (VALUES (0::BIGINT, 3.0::DOUBLE, 6.0::DOUBLE), (0, 2.0, 4.0)) AS t(map_id, lower, upper)")
def barcode_image(spark, sf_dir):
    return barcode.image(*_example(spark))


@query("SELECT * FROM (VALUES (0::BIGINT, 6.0::DOUBLE, 7.0::DOUBLE), (0, 4.0, 5.0)) AS t(map_id, lower, upper)")
def barcode_kernel(spark, sf_dir):
    return barcode.kernel(*_example(spark))


@query("SELECT * FROM (VALUES (0::BIGINT, 0.0::DOUBLE, 2.0::DOUBLE), (0, 1.0, 3.0)) AS t(map_id, lower, upper)")
def barcode_cokernel(spark, sf_dir):
    return barcode.cokernel(*_example(spark))


@query("WITH b AS (SELECT s_suppkey AS map_id, floor(s_acctbal / 1000)::DOUBLE AS l, (s_suppkey % 7)::DOUBLE + floor(s_acctbal / 1000) AS u FROM supplier) SELECT map_id, (l >= l - map_id % 3 AND u >= l - map_id % 3 + map_id % 5 AND l <= l - map_id % 3 + map_id % 5 AND u >= l - map_id % 3) AS valid FROM b")
def barcode_map_valid(spark, sf_dir):
    low = F.floor(F.col("s_acctbal") / 1000).cast("double")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("map_id"), F.lit(0).alias("k"), low.alias("lower"), (low + F.col("s_suppkey") % 7).alias("upper"))
    start = F.col("lower") - F.col("map_id") % 3
    target = rows.select("map_id", "k", start.alias("lower"), (start + F.col("map_id") % 5).alias("upper"))
    mat = rows.select("map_id", F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(1.0).alias("x"))
    return barcode.is_map(rows, target, mat)


@query("WITH v AS (SELECT range AS v FROM range(16)) SELECT 0::BIGINT AS space_id, a.v AS src, b.v AS dst, bit_count(xor(a.v, b.v))::DOUBLE AS d FROM v a JOIN v b ON a.v < b.v")
def hypercube_distance(spark, sf_dir):
    return M.distances(source.hypercube(spark, 4), source.hamming)


_ACT = "perm AS (SELECT * FROM (VALUES (0,0,1,2),(1,0,2,1),(2,1,0,2),(3,1,2,0),(4,2,0,1),(5,2,1,0)) AS t(g, a, b, c)), act AS (SELECT g, v, ((v & 1) << a) + (((v >> 1) & 1) << b) + (((v >> 2) & 1) << c) AS gv FROM perm, (SELECT range AS v FROM range(8))), ed AS (SELECT x.range AS i, y.range AS j FROM range(8) x, range(8) y WHERE x.range < y.range), img AS (SELECT DISTINCT i, j, least(p.gv, q.gv) AS a, greatest(p.gv, q.gv) AS b FROM ed JOIN act p ON p.v = i JOIN act q ON q.v = j AND q.g = p.g)"


def _cube_edges(spark):
    return spark.range(28).select(S.from_index(F.col("id"), 2, 8).alias("cell"))


@query(f"WITH {_ACT} SELECT concat_ws('-', i, j) AS cell, concat_ws('-', a, b) AS image FROM img")
def orbits(spark, sf_dir):
    return symmetry.orbits(_cube_edges(spark), symmetry.hypercube_action(spark, 3)).select(_name(), F.array_join(F.transform("image", lambda v: v.cast("string")), "-").alias("image"))


@query(f"WITH {_ACT}, m AS (SELECT i, j, min([a, b]) AS r FROM img GROUP BY ALL) SELECT concat_ws('-', i, j) AS cell FROM m WHERE r = [i, j]")
def orbit_representatives(spark, sf_dir):
    kept = symmetry.only_representatives(_cube_edges(spark), symmetry.hypercube_action(spark, 3), symmetry.hypercube_generators(spark, 3))
    return kept.select(_name())


@query("WITH v AS (SELECT range AS v FROM range(8)) SELECT concat_ws('-', a.v, b.v) AS cell FROM v a JOIN v b ON a.v < b.v")
def expand_orbits(spark, sf_dir):
    action = symmetry.hypercube_action(spark, 3)
    return symmetry.expand(symmetry.only_representatives(_cube_edges(spark), action), action).select("cell").select(_name())


def torus() -> simplicial.SimplicialSet:
    return simplicial.product(simplicial.sphere(1), simplicial.sphere(1))


@query("SELECT * FROM (VALUES (0, 1::BIGINT), (1, 3), (2, 2)) AS t(dim, n)")
def sset_product_cells(spark, sf_dir):
    return torus().cells(spark).groupBy("dim").agg(F.count("*").alias("n"))


@query("SELECT 0::BIGINT AS chi")
def sset_euler(spark, sf_dir):
    return rips.euler_characteristic(torus().cells(spark)).select("chi")


@query("SELECT * FROM (VALUES (0, 0.0::DOUBLE, 'infinity'::DOUBLE), (1, 1.0, 2.0), (1, 1.0, 'infinity'), (1, 1.0, 'infinity'), (2, 2.0, 'infinity')) AS t(dim, birth, death)")
def sset_torus_homology(spark, sf_dir):
    own = torus()
    bars = homology.persistent_homology(own.cells(spark, f=lambda g, d: d), own.boundary(spark), fields.Reals())
    return homology.diagram_at(bars, 5.0).select("dim", "birth", "death")


@query(f"WITH {_D}, b AS (SELECT space_id, src AS a, dst AS c, d * d AS q FROM dist UNION ALL SELECT space_id, dst, src, d * d FROM dist) SELECT space_id, concat_ws('-', src, dst) AS cell, round(d, 6) AS f FROM dist WHERE NOT EXISTS (SELECT 1 FROM b x JOIN b y ON x.space_id = y.space_id AND x.c = y.c WHERE x.space_id = dist.space_id AND x.a = dist.src AND y.a = dist.dst AND (x.q + y.q) / 2 - d * d / 4 < d * d / 4 * (1 - 1e-9) * (1 - 1e-9))")
def gabriel_edges(spark, sf_dir):
    return rips.gabriel(spaces(spark, sf_dir), 1).filter("dim = 1").select("space_id", _name(), _d("f"))


@query("SELECT n_nationkey, translate(n_nationkey::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') AS raised, translate(n_nationkey::VARCHAR, '0123456789', '₀₁₂₃₄₅₆₇₈₉') AS lowered FROM nation")
def unicode_labels(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", text.superscript(key).alias("raised"), text.subscript(key).alias("lowered"))


_CUBE = "u AS (SELECT range AS v FROM range(8)), h AS (SELECT a.v AS i, b.v AS j, bit_count(xor(a.v, b.v))::DOUBLE AS d FROM u a JOIN u b ON a.v < b.v)"


def _cube(spark, max_dim: int = 7) -> DataFrame:
    points = source.hypercube(spark, 3)
    return rips.vietoris_rips(points, 4.0, max_dim, metric=source.hamming)


@query(f"""WITH {_CUBE}, m AS (SELECT range AS mask FROM range(1, 256)), c AS (SELECT mask, bit_count(mask)::INT - 1 AS dim, coalesce((SELECT max(d) FROM h WHERE (mask >> i) & 1 = 1 AND (mask >> j) & 1 = 1), 0.0) AS f FROM m)
 SELECT dim, f, count(*) AS n FROM c GROUP BY ALL""")
def hypercube_cells(spark, sf_dir):
    """All 255 cells of the 3-cube's complex, by dimension and value."""
    return _cube(spark).groupBy("dim", "f").agg(F.count("*").alias("n"))


@query(f"WITH {_CUBE} SELECT 'strict' AS bound, i AS src, j AS dst, d FROM h WHERE d < 2 UNION ALL SELECT 'inclusive', i, j, d FROM h WHERE d <= 2")
def rips_edges_tied(spark, sf_dir):
    """Strict and inclusive bounds where many edges have the bound's length."""
    points = source.hypercube(spark, 3)
    strict, inclusive = (M.edges(points, 2.0, inclusive=i, metric=source.hamming).select(F.lit(name).alias("bound"), "src", "dst", "d") for i, name in ((False, "strict"), (True, "inclusive")))
    return strict.unionByName(inclusive)


_CUBE_CELLS = _CUBE + """, c3 AS (SELECT a.i, a.j, b.j AS k, greatest(a.d, b.d, x.d) AS f FROM h a JOIN h b ON b.i = a.j JOIN h x ON x.i = a.i AND x.j = b.j),
 cs AS (SELECT [v] AS cell, 0 AS dim, v::BIGINT AS idx, 0.0::DOUBLE AS f FROM u UNION ALL SELECT [i, j], 1, (i + j * (j - 1) // 2)::BIGINT, d FROM h UNION ALL SELECT [i, j, k], 2, (i + j * (j - 1) // 2 + k * (k - 1) * (k - 2) // 6)::BIGINT, f FROM c3),
 inc AS (SELECT a.dim, a.idx, a.cell, b.idx AS up, b.cell AS upcell FROM cs a JOIN cs b ON b.dim = a.dim + 1 AND a.f = b.f AND list_has_all(b.cell, a.cell)),
 pc AS (SELECT dim, idx, max(up) AS pivot_cofacet FROM inc WHERE upcell[-1] > cell[-1] GROUP BY ALL), pf AS (SELECT dim + 1 AS dim, up AS idx, max(idx) AS pivot_facet FROM inc GROUP BY ALL),
 ap AS (SELECT pc.dim, pc.idx, pc.pivot_cofacet AS apparent_cofacet FROM pc JOIN pf ON pf.dim = pc.dim + 1 AND pf.idx = pc.pivot_cofacet AND pf.pivot_facet = pc.idx)"""


@query(f"WITH {_CUBE_CELLS} SELECT array_to_string(cell, '-') AS cell, pivot_cofacet, pivot_facet, a.apparent_cofacet, b.idx AS apparent_facet FROM cs LEFT JOIN pc USING (dim, idx) LEFT JOIN pf USING (dim, idx) LEFT JOIN ap a USING (dim, idx) LEFT JOIN ap b ON b.dim = cs.dim - 1 AND b.apparent_cofacet = cs.idx")
def zero_pivots(spark, sf_dir):
    return rips.zero_pivots(_cube(spark, 2), 8).select(_name(), "pivot_cofacet", "pivot_facet", "apparent_cofacet", "apparent_facet")


@query(f"WITH {_D}, b AS (SELECT space_id, src AS v, d FROM dist UNION ALL SELECT space_id, dst, d FROM dist), r AS (SELECT space_id, min(m) AS r FROM (SELECT space_id, v, max(d) AS m FROM b GROUP BY ALL) GROUP BY space_id), e AS (SELECT dist.* FROM dist JOIN r USING (space_id) WHERE d <= r) SELECT space_id, 0 AS dim, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT space_id, 1, count(*) FROM e GROUP BY ALL")
def rips_cut_at_radius(spark, sf_dir):
    return rips.f_vector_at_radius(spaces(spark, sf_dir))


@query(f"WITH {_CELLS} SELECT space_id, array_to_string(cell, '-') AS cell, round(f, 6) AS f FROM cells WHERE cell[1] % 2 = 0")
def rips_kept_cells(spark, sf_dir):
    """A criterion on cells: the first vertex is even."""

    def kept(*vertices: str):
        return F.get(F.array(*vertices), 0) % 2 == 0

    points = spaces(spark, sf_dir)
    low = points.filter(kept("v")).select("space_id", F.col("v").cast("string").alias("cell"), F.lit(0.0).alias("f"))
    middle = tiles.edges(points, TRIANGLE).filter(kept("src", "dst")).select("space_id", _joined("src", "dst").alias("cell"), _millionths("d").alias("f"))
    rows = rips.triangles(points, TRIANGLE, of_edge={"start": F.concat(_joined("src", "dst"), F.lit("-"))}).filter(kept("src", "dst", "w"))
    high = rows.select("space_id", F.concat("start", F.col("w").cast("string")).alias("cell"), _millionths("f"))
    return low.unionByName(middle).unionByName(high)


@query(f"WITH {_CELLS} SELECT space_id, array_to_string(cell, '-') AS cell, round(f, 6) AS f FROM (SELECT *, row_number() OVER (PARTITION BY space_id ORDER BY f, dim, cell) AS i FROM cells) WHERE i = 101")
def cell_at_place(spark, sf_dir):
    return rips.cell_at(spaces(spark, sf_dir), TRIANGLE, 100).select("space_id", _name(), _d("f"))


@query(f"WITH {_D} SELECT a.space_id, concat_ws('-', a.src, a.dst, b.dst) AS cell, round(greatest(a.d, b.d, x.d), 6) AS f FROM dist a JOIN dist b ON b.space_id = a.space_id AND b.src = a.dst JOIN dist x ON x.space_id = a.space_id AND x.src = a.src AND x.dst = b.dst")
def triangle_diameters(spark, sf_dir):
    """The filtration value of every triangle by its largest distance."""
    from skeinlab.sources.cells import with_diameter

    d = M.distances(spaces(spark, sf_dir))
    cells = rips.stratified(spaces(spark, sf_dir), d, 2)[2].select("space_id", "cell")
    return with_diameter(cells, d).select("space_id", _name(), _d("f"))


@query(f"WITH {_P} SELECT space_id, count(*) AS n, count(*) FILTER (v % 3 = 0) AS asked FROM p GROUP BY space_id")
def space_sizes(spark, sf_dir):
    points = spaces(spark, sf_dir)
    third = M.elements(points).filter(F.col("v") % 3 == 0)
    asked = M.contained(points, third.unionByName(third.withColumn("v", -F.col("v") - 1))).groupBy("space_id").agg(F.count("*").alias("asked"))
    return M.sizes(points).join(asked, "space_id", "left").select("space_id", "n", F.coalesce("asked", F.lit(0)).cast("long").alias("asked"))


@query(f"WITH {_P} SELECT q.vec_id AS query, space_id, v FROM embeddings q JOIN p ON list_distance(q.embedding::DOUBLE[], p.x) <= 1.2")
def neighbours_of_queries(spark, sf_dir):
    points = spaces(spark, sf_dir)
    every = points.select("space_id").distinct().withColumnRenamed("space_id", "s")
    queries = points.select(F.col("v").alias("query"), "coords").join(F.broadcast(every)).select("query", F.col("s").alias("space_id"), "coords")
    return M.neighbours_of(queries, points, 1.2)


@query(f"WITH {_D} SELECT space_id, src, dst, round(d, 6) AS d FROM dist WHERE d <= 1.2")
def grid_neighbours(spark, sf_dir):
    """Pairs within a radius by grid cells, with whole coordinates."""
    return M.within(spaces(spark, sf_dir), 1.2).select("space_id", "src", "dst", _d())


@query(f"WITH {_T} SELECT space_id, concat_ws('-', i, j, k) AS cell, unnest([concat_ws('-', j, k), concat_ws('-', i, k), concat_ws('-', i, j)]) AS facet, unnest([j + k * (k - 1) // 2, i + k * (k - 1) // 2, i + j * (j - 1) // 2])::BIGINT AS facet_index FROM t")
def facet_indices(spark, sf_dir):
    return _facets(spark, sf_dir).select("space_id", "cell", "facet", S.index_of(F.col("low"), F.col("high")).alias("facet_index"))


@query(f"WITH {_V} SELECT concat_ws('-', i, j) AS cell, unnest([i::VARCHAR, j::VARCHAR, concat_ws('-', i, j)]) AS face, '∆(' || i || ',' || j || ')' AS shown FROM c")
def sub_simplices(spark, sf_dir):
    rows = _edges_of_ten(spark).withColumn("face", F.explode(S.sub_simplices(F.col("cell"))))
    return rows.select(_name(), F.array_join(F.transform("face", lambda v: v.cast("string")), "-").alias("face"), S.show(F.col("cell")).alias("shown"))


@query(f"WITH {_CH}, s AS (SELECT chain_id, cell, sum(coeff) AS c FROM ch GROUP BY chain_id, ch.cell HAVING abs(sum(coeff)) >= 1e-9) SELECT chain_id, count(*)::INT AS terms, sum(c)::DOUBLE AS total FROM s GROUP BY chain_id")
def chain_items(spark, sf_dir):
    rows = chains.items(chains.collapse(_chains(spark, sf_dir)))
    return rows.select("chain_id", F.size("terms").alias("terms"), F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["coeff"]).alias("total"))


@query(f"WITH {_CH}, s AS (SELECT chain_id, cell, sum(coeff) AS c FROM ch GROUP BY chain_id, ch.cell HAVING abs(sum(coeff)) >= 1e-9), m AS (SELECT chain_id, max([cell[1] % 7, cell[1], cell[2], cell[3]]) AS k FROM s GROUP BY chain_id) SELECT chain_id, array_to_string(cell, '-') AS cell, c::DOUBLE AS coeff FROM s JOIN m USING (chain_id) WHERE [cell[1] % 7, cell[1], cell[2], cell[3]] = k")
def chain_leading_term(spark, sf_dir):
    """The latest term, where a cell's value is its first vertex modulo 7."""
    own = _chains(spark, sf_dir)
    cells = own.select("cell").distinct().withColumn("f", (F.get("cell", 0) % 7).cast("double"))
    return chains.leading_term(own, cells).select("chain_id", _name(), "coeff")


@query(f"WITH {_CH} SELECT chain_id FROM (SELECT DISTINCT chain_id FROM ch) WHERE chain_id NOT IN (SELECT chain_id FROM ch WHERE chain_id % 3 <> 0 AND coeff <> 0)")
def chain_zeros(spark, sf_dir):
    """Chains that are zero, after those of every third id are taken from themselves."""
    own = _chains(spark, sf_dir)
    third = F.col("chain_id") % 3 == 0
    left = chains.plus(own.filter(~third).withColumn("coeff", F.abs("coeff")), chains.minus(own.filter(third), own.filter(third)))
    return chains.zero_chains(own.select("chain_id").distinct(), left)


@query("WITH n AS (SELECT range - 40 AS a FROM range(81)), p AS (SELECT x.a, y.a AS b, (((x.a - y.a) % 17) + 17) % 17 AS s, ((-x.a % 17) + 17) % 17 AS g, ((x.a % 17) + 17) % 17 AS r FROM n x, n y) SELECT a, b, " + _N.format("s") + " AS minus, " + _N.format("g") + " AS negated, r AS residue, 'Fp(' || " + _N.format("r") + " || ')' AS shown FROM p")
def fp_more(spark, sf_dir):
    f = fields.Prime(17)
    rows = spark.range(81 * 81).select((F.floor(F.col("id") / 81) - 40).alias("a"), (F.col("id") % 81 - 40).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("a", "b", f.minus(a, b).alias("minus"), f.negate(a).alias("negated"), f.unsigned(a).alias("residue"), f.show(a).alias("shown"))


@query("WITH n AS (SELECT range AS a FROM range(17)), i AS (SELECT y.a AS b, x.a AS inv FROM n x JOIN n y ON (x.a * y.a) % 17 = 1), q AS (SELECT n.a, b, (n.a * inv) % 17 AS q FROM n, i) SELECT a, b, " + _N.format("q") + " AS quotient FROM q")
def fp_divide(spark, sf_dir):
    rows = spark.range(17 * 16).select(F.floor(F.col("id") / 16).alias("a"), (F.col("id") % 16 + 1).alias("b"))
    return rows.select("a", "b", fields.Prime(17).divide(F.col("a"), F.col("b")).alias("quotient"))


@query(_H1)
def persistence_distributed(spark, sf_dir):
    """The same bars by rounds of column additions over the whole table."""
    bars = homology.bars_of_points(spaces(spark, sf_dir), TRIANGLE, in_rounds=True)
    return bars.select("space_id", "dim", _d("birth"), _d("death"))


@query(f"WITH RECURSIVE {_REDUCED} SELECT space_id, round(birth, 6) AS birth, round(death, 6) AS death, round(birth, 6) AS top, 0::BIGINT AS faces FROM bars WHERE dim = 1 AND death > birth")
def representative_cycle_facts(spark, sf_dir):
    """Of each representative cycle, the value of its latest edge, and how many terms its boundary has."""
    found = homology.persistent_homology(complex_of(spark, sf_dir), field=fields.Reals()).filter("dim = 1 AND death > birth")
    found = found.withColumn("chain_id", F.concat_ws(":", "space_id", F.array_join(F.transform("birth_cell", lambda v: v.cast("string")), "-")))
    terms = found.select("chain_id", "space_id", "birth", "death", F.explode("cycle").alias("t")).select("chain_id", "space_id", "birth", "death", "t.cell", "t.coeff")
    faces = chains.boundary(terms).groupBy(F.col("chain_id").alias("_c")).agg(F.count("*").alias("faces"))
    own = complex_of(spark, sf_dir).filter("dim = 1").select(F.col("space_id").alias("_s"), F.col("cell").alias("_cell"), "f")
    tops = terms.join(own, (F.col("space_id") == F.col("_s")) & (F.col("cell") == F.col("_cell"))).groupBy("chain_id", "space_id", "birth", "death").agg(F.max("f").alias("top"))
    return tops.join(faces, F.col("chain_id") == F.col("_c"), "left").select("space_id", _d("birth"), _d("death"), _d("top"), F.coalesce("faces", F.lit(0)).cast("long").alias("faces"))


@query(f"WITH RECURSIVE {_PRIM} SELECT space_id, src, dst, 1::BIGINT AS others, 0::BIGINT AS faces FROM (SELECT * FROM dist WHERE d < {EDGE}) ANTI JOIN mst USING (space_id, src, dst)")
def fundamental_cycle_facts(spark, sf_dir):
    """Of each fundamental cycle, how many edges lie outside the forest, and how many terms its boundary has."""
    return spanning.cycle_facts(spaces(spark, sf_dir), EDGE)


_ORBITS = _ACT + ", m AS (SELECT i, j, min([a, b]) AS r FROM img GROUP BY ALL), reps AS (SELECT i, j FROM m WHERE r = [i, j]), ex AS (SELECT i, j, a, b, row_number() OVER (ORDER BY i, j, a, b) - 1 AS place FROM img JOIN reps USING (i, j))"


@query(f"WITH {_ORBITS} SELECT concat_ws('-', i, j) AS cell, count(*) AS size, min(place)::BIGINT AS start FROM ex GROUP BY i, j")
def orbit_ranges(spark, sf_dir):
    action = symmetry.hypercube_action(spark, 3)
    return symmetry.orbit_ranges(symmetry.only_representatives(_cube_edges(spark), action), action).select(_name(), "size", "start")


@query(f"WITH {_ORBITS} SELECT place::INT AS place, concat_ws('-', a, b) AS cell FROM ex WHERE place IN (0, 5, 20, 27)")
def orbit_elements(spark, sf_dir):
    action = symmetry.hypercube_action(spark, 3)
    kept = symmetry.only_representatives(_cube_edges(spark), action)
    parts = [symmetry.element(kept, action, i).select(F.lit(i).alias("place"), _name()) for i in (0, 5, 20, 27)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {_CUBE} SELECT concat_ws('-', i, j) AS cell, d AS f FROM h")
def symmetric_edges(spark, sf_dir):
    """The cube's edges from the representatives of its orbits alone."""
    cells = _cube(spark, 1).filter("dim = 1")
    return symmetry.symmetric_cells(cells, symmetry.hypercube_action(spark, 3)).select(_name(), "f")


_M2 = "m AS (SELECT s_suppkey AS map_id, (s_suppkey % 4)::DOUBLE AS a, (s_suppkey % 5)::DOUBLE AS b, (s_suppkey % 3)::DOUBLE AS c, (s_suppkey % 2)::DOUBLE AS d FROM supplier), n AS (SELECT map_id, a, c, CASE WHEN c <> 0 AND d <> 0 THEN b - d / c * a WHEN c = 0 AND d = 0 AND a <> 0 THEN 0 ELSE b END AS b, CASE WHEN c <> 0 THEN 0 ELSE d END AS d FROM m), x AS (SELECT map_id, unnest([0, 1, 0, 1])::BIGINT AS row, unnest([0, 0, 1, 1])::BIGINT AS col, unnest([a, c, b, d])::DOUBLE AS x FROM n)"


def _matrices(spark, sf_dir) -> DataFrame:
    key = F.col("s_suppkey")
    terms = F.array(*(F.struct(F.lit(r).cast("long").alias("row"), F.lit(c).cast("long").alias("col"), (key % k).cast("double").alias("x")) for r, c, k in ((0, 0, 4), (1, 0, 3), (0, 1, 5), (1, 1, 2))))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(key.alias("map_id"), F.explode(terms).alias("t")).select("map_id", "t.row", "t.col", "t.x")


@query(f"WITH {_M2} SELECT map_id, row, col, round(x, 6) AS x FROM x WHERE abs(x) > 1e-9")
def matrix_reduced(spark, sf_dir):
    return barcode.reduce_matrix(_matrices(spark, sf_dir)).filter("abs(x) > 1e-9").select("map_id", "row", "col", _d("x"))


@query(f"WITH {_M2} SELECT map_id, col, max(row) AS row FROM x WHERE abs(x) > 1e-9 GROUP BY ALL")
def matrix_pivots(spark, sf_dir):
    return barcode.pivots_of(barcode.reduce_matrix(_matrices(spark, sf_dir)).filter("abs(x) > 1e-9")).select("map_id", "col", "row")


@query("SELECT c_custkey, (c_nationkey + 3 * (c_custkey % 5))::BIGINT AS a, (c_nationkey % 3 + 3 * 2)::BIGINT AS b, c_nationkey = 0 AND c_custkey % 5 = 0 AS zero FROM customer")
def module_arithmetic(spark, sf_dir):
    """u + 3 w in Z^2, for u = (nation, nation mod 3) and w = (customer mod 5, 2), and whether u + (customer mod 5, 0) is zero."""
    z2 = modules.Vectors(2, kind="long")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nation, five = F.col("c_nationkey").cast("long"), (F.col("c_custkey") % 5).cast("long")
    u, w = F.array(nation, nation % 3), F.array(five, F.lit(2).cast("long"))
    total = z2.minus(z2.plus(u, z2.scale(F.lit(3).cast("long"), w)), z2.negate(z2.zero()))
    plain = z2.plus(u, F.array(five, F.lit(0).cast("long")))
    return rows.select("c_custkey", F.get(total, F.lit(0)).alias("a"), F.get(total, F.lit(1)).alias("b"), z2.is_zero(plain).alias("zero"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcode in dimensions 0 and 1 of the Vietoris-Rips complex of every label's embeddings."""
    ship(spark)
    return homology.bars(complex_of(spark, sf_dir)).filter("dim < 2").select("space_id", "dim", _d("birth"), _d("death"))
