"""Exact small cases: complexes, homology, spanning forests, barcode maps, symmetry, simplicial sets."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from skeinlab import catalogue
from skeinlab.functions import fields
from skeinlab.functions import intervals as I
from skeinlab.functions import simplex as S
from skeinlab.functions import text
from skeinlab.operators import barcode, chains, homology, rips, spanning, symmetry, tiles
from skeinlab.operators import metric as M
from skeinlab.sources import metric as source
from skeinlab.sources import simplicial as ss
from skeinlab.sources.cells import ExplicitBuilder

INF = float("inf")


def bars_of(df):
    return sorted((r.dim, r.birth, r.death) for r in df.collect())


def triangle(spark):
    return ExplicitBuilder().add_all([(4, [1, 2, 3]), (0, [1]), (0, [2]), (0, [3]), (1, [1, 2]), (2, [1, 3]), (3, [2, 3])]).result(spark)


def k4(spark):
    edges = [(f + 1, e) for f, e in enumerate(itertools.combinations(range(1, 5), 2))]
    return ExplicitBuilder().add_all([*((0, [v]) for v in range(1, 5)), *edges]).result(spark)


@pytest.mark.parametrize("field", [fields.Prime(2), fields.Prime(3), fields.Reals()])
def test_filtered_triangle(spark, field):
    bars = homology.persistent_homology(triangle(spark), field=field)
    assert bars_of(homology.diagram_at(bars, 5.0)) == [(0, 0, 1), (0, 0, 2), (0, 0, INF), (1, 3, 4)]
    assert bars_of(homology.diagram_at(bars, 2.5)) == [(0, 0, 1), (0, 0, 2), (0, 0, INF)]


@pytest.mark.parametrize("make", [triangle, k4])
def test_distributed_form_agrees(spark, make):
    cells = make(spark)
    for field in (fields.Prime(2), fields.Prime(3)):
        assert bars_of(homology.distributed_pairs(cells, field)) == bars_of(homology.persistent_homology(cells, field=field))


def test_three_loops_of_k4(spark):
    assert bars_of(homology.persistent_homology(k4(spark))) == [(0, 0, 1), (0, 0, 2), (0, 0, 3), (0, 0, INF), (1, 4, INF), (1, 5, INF), (1, 6, INF)]


def test_cycles_have_no_boundary(spark):
    rnd = random.Random(1)
    points = spark.createDataFrame([(0, v, [rnd.random(), rnd.random()]) for v in range(9)], "space_id long, v long, coords array<double>")
    bars = homology.persistent_homology(rips.vietoris_rips(points), field=fields.Reals()).filter("dim = 1")
    terms = bars.withColumn("chain_id", F.monotonically_increasing_id()).select("chain_id", F.explode("cycle").alias("t")).select("chain_id", "t.cell", "t.coeff")
    assert terms.count() and chains.boundary(terms).count() == 0


def test_rips_is_every_clique(spark):
    rnd = random.Random(2)
    at = [[rnd.random(), rnd.random()] for _ in range(10)]
    points = spark.createDataFrame([(0, v, x) for v, x in enumerate(at)], "space_id long, v long, coords array<double>")

    def d(a, b):
        return sum((x - y) ** 2 for x, y in zip(at[a], at[b], strict=True)) ** 0.5

    want = {c for k in (1, 2, 3) for c in itertools.combinations(range(10), k) if all(d(a, b) < 0.6 for a, b in itertools.combinations(c, 2))}
    assert {tuple(r.cell) for r in rips.vietoris_rips(points, 0.6).collect()} == want
    assert M.within(points, 0.6).count() == sum(d(a, b) <= 0.6 for a, b in itertools.combinations(range(10), 2))
    assert rips.gabriel(points, 2).filter("dim = 0").count() == 10


def test_gabriel_graph_has_every_space_and_coordinate(spark, tmp_path):
    rnd = random.Random(3)
    at = {v: (v % 3, [rnd.random() for _ in range(4)]) for v in range(45)}
    spark.createDataFrame([(v, x, s) for v, (s, x) in at.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    at = {r.vec_id: (r.label, list(r.embedding)) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}

    def inside(a, b, c):
        return sum((z - x) * (z - y) for x, y, z in zip(at[a][1], at[b][1], at[c][1], strict=True)) < 0

    want = set()
    for a, b in itertools.combinations(sorted(at), 2):
        rest = [c for c in at if c not in (a, b) and at[c][0] == at[a][0]]
        if at[a][0] == at[b][0] and not any(inside(a, b, c) for c in rest):
            want.add((at[a][0], f"{a}-{b}"))
    got = [(r.space_id, r.cell) for r in catalogue.QUERIES["gabriel_edges"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and {s for s, _ in want} == {0, 1, 2} and len(want) < 315


def test_spanning_tree_of_a_matrix(spark):
    edges = source.explicit(spark, [[0, 1, 2], [1, 0, 3], [2, 3, 0]])
    points = spark.createDataFrame([(0, v) for v in range(3)], "space_id long, v long")
    assert sorted((r.src, r.dst) for r in spanning.kruskal(points, edges).collect()) == [(0, 1), (0, 2)]
    assert bars_of(spanning.h0_bars(points, edges)) == [(0, 0, 1), (0, 0, 2), (0, 0, INF)]
    cycle = spanning.fundamental_cycles(points, edges).collect()
    assert [(r.src, r.dst) for r in cycle] == [(1, 2)]
    terms = spark.createDataFrame([(0, list(t.cell), t.coeff) for t in cycle[0].cycle], "chain_id long, cell array<long>, coeff double")
    assert chains.boundary(terms).count() == 0


def test_indexing_vectors(spark):
    cases = [([0, 1, 2], 0), ([0, 1, 3], 1), ([0, 2, 3], 2), ([1, 2, 3], 3), ([0, 1, 4], 4), ([0, 3, 5], 13), ([0, 3, 5, 6], 28), ([0, 3, 4, 5], 12), ([0, 2, 3, 5], 7), ([0, 1, 3, 5], 6), ([0, 1, 3, 6, 8], 72)]
    rows = spark.createDataFrame([(c, i) for c, i in cases], "cell array<long>, i long")
    assert all(r.i == r.idx for r in rows.select("i", S.index(F.col("cell")).alias("idx")).collect())
    for cell, i in cases:
        assert list(spark.range(1).select(S.from_index(F.lit(i), len(cell), 15).alias("c")).first().c) == cell
    facets = S.facets(spark.createDataFrame([([1, 2, 4, 5],)], "cell array<long>"))
    assert sorted(r.facet_index for r in facets.collect()) == [6, 12, 17, 18]


def test_barcode_map_cases(spark):
    cases = [(0, 5, 0, 5, True), (0, 5, 1, 5, False), (0, 5, 0, 6, False), (0, 5, 1, 4, False), (0, 5, 6, 10, False), (10, 15, 6, 9, False), (10, 15, 0, 5, False), (10, 15, 5, 12, True), (10, 15, 11, 14, False), (10, 15, 12, 16, False), (10, 15, 16, 20, False)]
    schema = "map_id long, k long, lower double, upper double"
    a = spark.createDataFrame([(i, 0, float(c[0]), float(c[1])) for i, c in enumerate(cases)], schema)
    b = spark.createDataFrame([(i, 0, float(c[2]), float(c[3])) for i, c in enumerate(cases)], schema)
    m = spark.createDataFrame([(i, 0, 0, 1.0) for i in range(len(cases))], "map_id long, row long, col long, x double")
    assert [r.valid for r in barcode.is_map(a, b, m).orderBy("map_id").collect()] == [c[4] for c in cases]


def test_end_order_and_flip(spark):
    r = spark.range(1).select((I.minus_infinity() < I.closed(F.lit(0.0))).alias("a"), (I.closed(F.lit(1.0)) < I.opened(F.lit(1.0))).alias("b"), (I.opened(F.lit(1.0)) < I.plus_infinity()).alias("c"), I.flip(I.closed(F.lit(2.0))).alias("d")).first()
    assert r.a and r.b and r.c and r.d.open == 1


def test_field_laws(spark):
    f = fields.Prime(17)
    rows = spark.range(-60, 60).filter("pmod(id, 17) <> 0").select("id", f.norm(F.col("id")).alias("n"), f.times(F.col("id"), f.invert(F.col("id"))).alias("one"))
    assert all(r.one == 1 and -8 <= r.n <= 8 and (r.n - r.id) % 17 == 0 for r in rows.collect())
    assert fields.Prime(17).number(42) == 8


def test_cube_symmetry(spark):
    cells = spark.createDataFrame([(list(c),) for k in (1, 2, 3) for c in itertools.combinations(range(8), k)], "cell array<long>")
    action, gens = symmetry.hypercube_action(spark, 3), symmetry.hypercube_generators(spark, 3)
    plain = {tuple(r.cell) for r in symmetry.only_representatives(cells, action).collect()}
    assert plain == {tuple(r.cell) for r in symmetry.only_representatives(cells, action, gens).collect()}
    assert {(0,), (1,), (3,), (7,), (0, 1), (0, 3), (0, 1, 3)} <= plain and (0, 2) not in plain
    ordered = symmetry.orbit_ranges(spark.createDataFrame([([0, 1],), ([0, 3],)], "cell array<long>"), action).orderBy("start").collect()
    assert [(r.size, r.start) for r in ordered] == [(3, 0), (3, 3)]


def test_spheres_torus_and_quotients(spark):
    four = ss.sphere(4)
    assert bars_of(homology.persistent_homology(four.cells(spark), four.boundary(spark))) == [(0, 0, INF), (4, 0, INF)]
    torus = ss.product(ss.sphere(1), ss.sphere(1))
    assert torus.f_vector(2) == [1, 3, 2] and torus.euler() == 0
    disc = ss.simplex(2)
    rim = {g for g, d in disc.dims.items() if d < 2}
    assert ss.quotient(disc, [rim]).f_vector(2) == [1, 0, 1]
    assert ss.coproduct(disc, disc).euler() == 2 and disc.skeleton(1).euler() == 0
    assert len(ss.sphere(1).all_cells(2)) == 3
    point = ss.SimplicialSet({0: 0}, {})
    to_point = {0: (0, ()), 1: (0, (0,))}
    assert ss.pullback(ss.sphere(1), ss.sphere(1), to_point, to_point).f_vector(2) == torus.f_vector(2) and point.euler() == 1


@pytest.mark.parametrize("field", [fields.Prime(2), fields.Prime(5), fields.Reals()])
def test_bars_alone_are_those_with_cycles(field):
    rnd = random.Random(7)
    for n in (0, 1, 6, 9):
        cells = [(float(rnd.randrange(3)) if k else 0.0, k, c) for k in range(4) for c in itertools.combinations(range(n), k + 1)]
        value = {}
        for f, k, c in cells:
            value[c] = max([f, *(value[x] for x in itertools.combinations(c, k) if x)])
        own = [(value[c], k, c, [c[:i] + c[i + 1 :] for i in range(k + 1)] if k else [], [(-1) ** i for i in range(k + 1)] if k else []) for _, k, c in cells]
        rnd.shuffle(own)
        whole = sorted(x[:5] for x in homology.reduce_space(own, field))
        assert sorted(homology.reduce_bars([*own, *own[:3]], field), key=repr) == sorted(whole, key=repr)
    with pytest.raises(ValueError):
        list(homology.reduce_bars([(0.0, 0, (1,), [], []), (1.0, 1, (1, 2), [(2,), (1,)], [1, -1])], field))


def test_core_takes_odd_tables(spark):
    points = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 2, [1.0, 0.0]), (1, 5, [3.0, 3.0])], "space_id long, v long, coords array<double>")
    assert bars_of(homology.bars(rips.vietoris_rips(points))) == sorted([(0, 0, 0), (0, 0, 1), (0, 0, INF), (0, 0, INF), (1, 1, 1)])
    assert bars_of(homology.by_dimension(points, M.edges(points), 2).select("dim", "birth", "death")) == bars_of(homology.bars(rips.vietoris_rips(points)))
    empty = points.filter("false")
    assert M.distances(empty).count() == homology.bars(rips.vietoris_rips(empty)).count() == rips.gabriel(empty, 1).count() == 0
    assert [tuple(r) for r in M.distances(points).orderBy("src", "dst").collect()] == [(0, 0, 1, 1.0), (0, 0, 2, 1.0), (0, 1, 2, 0.0)]


@pytest.fixture(scope="module")
def clouds(spark):
    """Two spaces with copies of points, so that distances tie, and a point alone."""
    rnd = random.Random(5)
    at = [[rnd.random() for _ in range(5)] for _ in range(30)]
    rows = [(s, 7 * v + s, at[(v * (s + 1)) % (24 + s)]) for s in range(2) for v in range(40)] + [(2, 5, at[0])]
    return spark.createDataFrame(rows, "space_id long, v long, coords array<double>").cache()


@pytest.fixture(params=[16, 1024])
def block(request, monkeypatch):
    """Tiles of several blocks, and of one."""
    for name in ("BLOCK", "WIDE"):
        monkeypatch.setattr(tiles, name, request.param)
    monkeypatch.setattr(tiles.tiled, "__defaults__", (request.param,))
    monkeypatch.setattr(tiles.tiled_by_grid, "__defaults__", (request.param,))


def same(a, b):
    a, b = (sorted(map(tuple, x.collect())) for x in (a, b))
    assert a == b and a


def test_tiles_give_the_edges_of_the_join(clouds, block):
    for bound, inclusive in ((0.6, False), (0.2, True), (INF, False)):
        d = M.distances(clouds)
        want = d.filter(F.col("d") <= bound) if inclusive else d.filter(F.col("d") < bound)
        same(tiles.edges(clouds, bound, inclusive), want)
        counts = tiles.count_edges(clouds, bound, inclusive)
        same(counts.filter("n > 0"), want.groupBy("space_id").agg(F.count("*").alias("n")))


def test_grid_tiles_give_the_edges_of_the_join(clouds, block):
    same(M.within(clouds, 0.4), M.distances(clouds).filter("d <= 0.4"))


def test_forest_of_points_is_that_of_all_edges(clouds, block, monkeypatch):
    for bound in (0.5, INF):
        forest, labels = spanning.spanning_forest(clouds, M.distances(clouds).filter(F.col("d") < bound))
        least = labels.join(labels.groupBy("space_id", "root").agg(F.min("v").alias("c")), ["space_id", "root"]).select("space_id", "v", "c")
        for largest in (5_000_000, 1):
            monkeypatch.setattr(spanning, "LARGEST", largest)
            own = spanning.forest_of_points(clouds, bound)
            same(own[0], forest)
            same(own[1], least)
    same(spanning.off_the_forest(clouds), spanning.non_tree_edges(clouds, M.distances(clouds)))


def test_cells_are_counted_without_being_made(clouds, block):
    cells = rips.vietoris_rips(clouds, 0.6)
    same(rips.f_vector_of_points(clouds, 0.6), rips.f_vector(cells))
    same(rips.euler_of_points(clouds, 0.6), rips.euler_characteristic(cells))
    same(rips.f_vector_at_radius(clouds), rips.f_vector(rips.cut_at_radius(clouds, 1)))


def test_cell_at_a_place_without_the_complex(clouds, block):
    from skeinlab.sources.cells import at

    for i in (0, 39, 45, 150, 900):
        same(rips.cell_at(clouds, 0.6, i).unionByName(rips.cell_at(clouds, 0.6, 0)), at(rips.vietoris_rips(clouds, 0.6), i).unionByName(at(rips.vietoris_rips(clouds, 0.6), 0)))


def test_apparent_pairs_without_triangles(clouds):
    names = ("space_id", "birth", "death")
    same(rips.apparent_pairs_of_points(clouds, 0.7).select(*names), rips.apparent_pairs(rips.vietoris_rips(clouds, 0.7)).select(*names))


@pytest.mark.parametrize("first", [1, 4, 32])
def test_apparent_triangles_in_blocks_without_a_list_of_edges(clouds, monkeypatch, first):
    """Few vertices at a time, with ties and with coordinates of several lengths; no row is made for each edge."""
    monkeypatch.setattr(tiles.apparent_triangles, "__defaults__", (16, first))
    monkeypatch.setattr(tiles, "BATCH", 100)
    wanted = [(p, rips.apparent_pairs(rips.vietoris_rips(p, 0.7)).collect()) for p in (clouds, clouds.withColumn("coords", F.slice("coords", 1, 3 + F.col("v").cast("int") % 3)))]
    monkeypatch.setattr(tiles, "edges", None)
    for points, rows in wanted:
        found = tiles.apparent_triangles(points, 0.7).collect()
        want = [(r.space_id, *r.birth.cell, *r.death.cell) for r in rows]
        got = [(r.space_id, r.dst, r.src, r.dst) if r.w is None else (r.space_id, r.src, r.dst, *sorted((r.src, r.dst, r.w))) for r in found]
        assert sorted(got) == sorted(want) and any(r.w is None for r in found) and any(r.w is not None for r in found)
        assert all(r.d == r2.birth.f for r, r2 in zip(sorted((r for r in found if r.w is not None), key=lambda r: (r.space_id, r.src, r.dst)), sorted((r for r in rows if r.birth.dim), key=lambda r: (r.space_id, *r.birth.cell)), strict=True))


def test_neighbours_of_queries_by_tiles(clouds, block):
    queries = clouds.select(F.col("v").alias("query"), "coords").crossJoin(clouds.select("space_id").distinct())
    near = queries.join(clouds.withColumnRenamed("coords", "x"), "space_id").filter(M.euclidean(F.col("coords"), F.col("x")) <= 0.4).select("query", "space_id", "v")
    same(M.neighbours_of(queries, clouds, 0.4), near)


def test_bars_of_dimension_0_from_edges_of_tiles(clouds, block):
    cells = rips.concatenated(rips.stratified(clouds, tiles.forest_edges(clouds), 1))
    same(homology.bars(cells).filter("dim = 0").select("space_id", "birth", "death"), homology.bars(rips.vietoris_rips(clouds, max_dim=1)).filter("dim = 0").select("space_id", "birth", "death"))


def test_gabriel_edges_with_copies_of_points(clouds):
    """Several blocks, and copies that lie on the balls of others."""
    own = {}
    for r in clouds.collect():
        own.setdefault(r.space_id, {})[r.v] = r.coords

    def q(x, y):
        return sum((a - b) ** 2 for a, b in zip(x, y, strict=True))

    want = set()
    for s, at in own.items():
        for a, b in itertools.combinations(sorted(at), 2):
            ab = q(at[a], at[b])
            if not any((q(at[a], at[c]) + q(at[b], at[c])) / 2 - ab / 4 < ab / 4 * (1 - 1e-9) ** 2 for c in at if c not in (a, b)):
                want.add((s, a, b))
    for block in (8, 256):
        got = [(r.space_id, *r.cell) for r in rips.gabriel_edges(clouds, block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_fundamental_cycles_by_tiles(clouds, block):
    """The same terms as those of the general form."""
    edges = M.distances(clouds).filter("d < 0.7")
    want = {(r.space_id, r.src, r.dst): sorted((r.cycle).split(" + ")) for r in spanning.fundamental_cycles(clouds, edges).withColumn("cycle", text.show_chain(F.col("cycle"))).collect()}
    got = spanning.shown_cycles(clouds, 0.7).collect()
    assert got and len(got) == len(want) and {(r.space_id, r.src, r.dst): sorted(r.cycle.split(" + ")) for r in got} == want
    facts = spanning.cycle_facts(clouds, 0.7).collect()
    assert {(r.space_id, r.src, r.dst) for r in facts} == set(want) and len(facts) == len(want) and {(r.others, r.faces) for r in facts} == {(1, 0)}


def test_fundamental_cycles_leave_a_tile_in_small_batches(clouds, monkeypatch):
    """No task holds the text of all its cycles: of 60 points on a line, those of 1,711 edges."""
    import pyarrow as pa
    from pyspark.sql.group import GroupedData

    kernels = []
    apply = GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, f, schema: kernels.append(f) or apply(self, f, schema))
    monkeypatch.setattr(spanning, "AT_ONCE", 20_000, raising=False)
    spanning.shown_cycles(clouds, 2.5)
    n = 60
    tile = pa.table({"space_id": [7] * n, "lo": [0] * n, "hi": [0] * n, "first": [True] * n, "v": list(range(n)), "coords": [[v / n] for v in range(n)], "path": [list(range(v + 1)) for v in range(n)]})
    batches = list(kernels[-1](iter(tile.to_batches())))
    rows = [r for b in batches for r in b.to_pylist()]
    assert sorted((r["src"], r["dst"]) for r in rows) == [(i, j) for i in range(n) for j in range(i + 2, n)]
    assert all(r["space_id"] == 7 and r["cycle"].count("⊠") == r["dst"] - r["src"] + 1 for r in rows)
    assert len(batches) > 10 and max(sum(len(x) for x in b.column("cycle").to_pylist()) for b in batches) < 25_000


@pytest.mark.parametrize("width", [2, 1024])
def test_bars_of_dimension_1_without_triangles(clouds, block, monkeypatch, width):
    from skeinlab.operators import loops

    monkeypatch.setattr(loops, "BLOCK", 16)
    monkeypatch.setattr(loops, "RANGE", width)
    for bound in (0.5, 0.7, INF):
        want = homology.bars(rips.vietoris_rips(clouds, bound)).filter("dim <= 1").select("space_id", "dim", "birth", "death")
        for in_rounds in (False, True):
            same(homology.bars_of_points(clouds, bound, in_rounds), want)


def test_a_space_of_loops_holds_little_more_than_its_ranks():
    """Under 12 bytes for each pair of 700 points, where matrices of distances took over 20; first vertices are those of all triangles."""
    import tracemalloc

    import numpy as np

    from skeinlab.operators import loops

    n = 700
    points = tiles.Side(np.arange(n), np.random.default_rng(0).random((8, n)), np.full(n, 8))
    tracemalloc.start()
    space = loops.Space(points, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * n * n
    for r in range(0, space.edges, 50):
        early = np.flatnonzero(np.maximum(space.rank[space.src[r]], space.rank[space.dst[r]]) < r)
        assert space.first[r] == (early[0] if len(early) else -1)
    assert (np.diff(space.d) >= 0).all() and space.tree.sum() == n - 1


@pytest.fixture(scope="module")
def embedded(spark, tmp_path_factory):
    """A folder with three spaces in embeddings.parquet, and its triangles below 1.36: (space, i, j, k) and the value."""
    rnd = random.Random(11)
    folder = str(tmp_path_factory.mktemp("embedded"))
    rows = [(7 * v, [rnd.random() * 1.2 for _ in range(5)], v % 3) for v in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    at = {(r.label, r.vec_id): r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    own = {s: sorted(v for x, v in at if x == s) for s in range(3)}
    d = {(s, a, b): sum((x - y) ** 2 for x, y in zip(at[s, a], at[s, b], strict=True)) ** 0.5 for s in own for a, b in itertools.combinations(own[s], 2)}
    value = {(s, *c): max(d[s, a, b] for a, b in itertools.combinations(c, 2)) for s in own for c in itertools.combinations(own[s], 3)}
    return folder, {c: f for c, f in value.items() if f < 1.36}, len(value)


@pytest.fixture
def without_joins(monkeypatch):
    def expand(*_):
        raise AssertionError("triangles by joins")

    monkeypatch.setattr(rips, "expand", expand)


def test_triangles_from_kernels_are_those_of_the_join(clouds, block, monkeypatch):
    """Copies of a vertex, with coordinates of their own or the same ones, close as they do in a join."""
    copied = clouds.filter("v % 5 = 0").withColumn("coords", F.transform("coords", lambda x: x + 0.01)).unionByName(clouds).unionByName(clouds.filter("v % 15 = 1"))
    monkeypatch.setattr(tiles, "BATCH", 100)
    monkeypatch.setattr(tiles, "AT_ONCE", 50)
    for points in (clouds, copied):
        for bound in (0.5, INF):
            want = rips.expand(rips.stratified(points, M.distances(points).filter(F.col("d") < bound), 1)[1], M.distances(points).filter(F.col("d") < bound))
            same(rips.triangles(points, bound), want.select("space_id", F.col("cell")[0], F.col("cell")[1], F.col("cell")[2], "f"))
            same(rips.triangles(points, bound, valued=False), want.select("space_id", F.col("cell")[0], F.col("cell")[1], F.col("cell")[2]))
    assert rips.triangles(clouds.filter("false"), 0.5).count() == 0


def test_boundary_matrix_without_joins(spark, embedded, block, without_joins):
    folder, triangles, every = embedded
    want = sorted((s, f"{i}-{j}-{k}", *x) for s, i, j, k in triangles for x in ((f"{j}-{k}", 1), (f"{i}-{k}", -1), (f"{i}-{j}", 1)))
    assert sorted(map(tuple, catalogue.QUERIES["boundary_matrix"](spark, folder).collect())) == want and 1000 < len(triangles) < every


def test_rips_triangles_without_joins(spark, embedded, block, without_joins):
    folder, triangles, _ = embedded
    got = sorted(map(tuple, catalogue.QUERIES["rips_triangles"](spark, folder).collect()))
    want = sorted((s, f"{i}-{j}-{k}", f) for (s, i, j, k), f in triangles.items())
    assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(x[2] - y[2]) < 5.1e-7 for x, y in zip(got, want, strict=True))


def test_millionths_are_those_of_round(spark):
    rnd = random.Random(12)
    values = [rnd.random() * 1.4 for _ in range(2000)] + [(2 * rnd.randrange(10**6) + 1) / 2e6 * (1 + e) for e in (-3e-10, -1e-16, 0, 1e-16, 3e-10) for _ in range(300)]
    values += [0.0, 1e-7, 1e12 + 0.1234565, -0.1234565, INF, -INF, float("nan")]
    rows = spark.createDataFrame([(x,) for x in values], "f double")
    assert rows.select(F.round("f", 6).alias("a"), catalogue._millionths("f").alias("b")).filter("NOT a <=> b").count() == 0


def test_sparse_metric_rounds_as_sql_does(spark, tmp_path):
    """Distances next to the middle between two millionths, and ones at the bound, beyond it, and that are no number."""
    import math

    import duckdb

    rnd = random.Random(3)
    ends = [0.7961104999999999, 0.9340444999999999, 1.4, math.nextafter(1.4, 2), math.nextafter(1.4, 1), 0.0, INF, float("nan")]
    for _ in range(500):
        x = (rnd.randrange(1_400_000) + 0.5) / 1e6
        ends += [x, math.nextafter(x, 0), math.nextafter(x, 2)]
    rows = [(k, [y], s) for s, x in enumerate(ends) for k, y in ((2 * s, 0.0), (2 * s + 1, x))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(base.execute(catalogue.ORACLE_SQL["sparse_metric"]).fetchall())
    got = sorted(map(tuple, catalogue.QUERIES["sparse_metric"](spark, str(tmp_path)).collect()))
    assert got == want and len(got) == len(ends)


def test_simplex_index_without_joins(spark, embedded, block, without_joins):
    folder, triangles, _ = embedded
    want = sorted((s, f"{i}-{j}-{k}", i + j * (j - 1) // 2 + k * (k - 1) * (k - 2) // 6) for s, i, j, k in triangles)
    assert sorted(map(tuple, catalogue.QUERIES["simplex_index"](spark, folder).collect())) == want


def test_index_of_vertices_is_the_index_of_the_cell(spark):
    """Beyond 2^53, too, and for vertices below their place."""
    cells = [[0, 1, 2], [3, 5, 9], [0, 1, 2_000_000], [1_999_998, 1_999_999, 2_000_000], [-2, 0, 1]]
    rows = spark.createDataFrame([(c,) for c in cells], "cell array<long>").select(S.index(F.col("cell")).alias("want"), S.index_of(*(F.col("cell")[i] for i in range(3))).alias("got"))
    assert [r.want for r in rows.collect()] == [r.got for r in rows.collect()]


def test_facet_indices_without_joins(spark, embedded, block, without_joins):
    folder, triangles, _ = embedded
    want = sorted((s, f"{i}-{j}-{k}", f"{a}-{b}", a + b * (b - 1) // 2) for s, i, j, k in triangles for a, b in ((j, k), (i, k), (i, j)))
    assert sorted(map(tuple, catalogue.QUERIES["facet_indices"](spark, folder).collect())) == want


def test_rips_kept_cells_without_joins(spark, embedded, block, without_joins):
    folder, triangles, _ = embedded
    got = {(r.space_id, *map(int, r.cell.split("-"))): r.f for r in catalogue.QUERIES["rips_kept_cells"](spark, folder).collect()}
    cells = {(v % 3, 7 * v): 0.0 for v in range(90)} | {(r.space_id, r.src, r.dst): r.d for r in M.edges(catalogue.spaces(spark, folder), catalogue.TRIANGLE).collect()} | triangles
    want = {c: f for c, f in cells.items() if c[1] % 2 == 0}
    assert set(got) == set(want) and all(abs(got[c] - f) < 5.1e-7 for c, f in want.items()) and len(want) < len(cells)


def test_boundary_squared_zero_without_joins(spark, embedded, block, without_joins, monkeypatch):
    """Every triangle is taken, and a wrong sign shows."""
    folder, triangles, _ = embedded
    points = catalogue.spaces(spark, folder)
    assert [r.n for r in catalogue.QUERIES["boundary_squared_zero"](spark, folder).collect()] == [0]
    assert [r.n for r in rips.boundary_twice(points.filter("false"), 1.36).collect()] == [0]
    seen = {r.space_id: r.n for r in tiles.over_triangles(points, 1.36, lambda i, j, k: int(((i < j) & (j < k)).sum())).groupBy("space_id").agg(F.sum("n").alias("n")).collect()}
    assert seen == {s: sum(c[0] == s for c in triangles) for s in range(3)}
    unsigned = rips.boundary_twice(points, 1.36, lambda terms: [(cell, abs(c)) for cell, c in chains.faces_of(terms)])
    assert [r.n for r in unsigned.collect()] == [3 * len(triangles)]


def test_terms_of_a_row_are_added_up():
    import numpy as np

    i, j, k = (np.array(x) for x in ([0, 3], [1, 4], [2, 9]))
    edges = chains.faces_of([((i, j, k), 1)])
    assert [c for _, c in edges] == [1, -1, 1] and chains.count_terms(edges) == 6
    assert chains.count_terms(chains.faces_of(edges)) == 0 and chains.count_terms([]) == 0
    assert chains.count_terms([((i,), 1), ((np.array([0, 5]),), 1), ((i,), -2)]) == 2


def test_names_of_the_package():
    import skeinlab

    assert all(hasattr(skeinlab, n) for n in skeinlab.__all__)
