import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg import commands as C
from thalweg.operators import kernels as K
from thalweg.operators import routing as R

Y = [(3, 0, 0.0, 30.0, 3.0), (3, 1, 0.0, 0.0, 0.0), (1, 0, -20.0, 50.0, 9.0), (1, 1, 0.0, 30.0, 3.0), (2, 0, 20.0, 50.0, 9.0), (2, 1, 0.0, 30.0, 3.0)]


@pytest.fixture
def v(spark):
    return spark.createDataFrame(Y, "cat long, seq int, x double, y double, z double")


def test_link_then_profile(v):
    seg = C.link_network(v)
    assert dict(seg.collect()) == {1: 3, 2: 3, 3: 0}
    down = C.profiles(v, seg, 1, values=("z",)).orderBy("i").collect()
    assert [(r.cat, r.z) for r in down] == [(1, 9.0), (1, 3.0), (3, 0.0)]
    up = C.profiles(v, seg, 3, "upstream", ("z",), dx_target=10.0, window=15.0)
    assert {r.head for r in up.select("head").distinct().collect()} == {1, 2} and up.filter("z_smoothed IS NULL").count() == 0
    with pytest.raises(ValueError):
        C.profiles(v, seg, 99)


def test_heads_by_each_method(spark):
    import numpy as np

    n = 24
    rough = np.random.default_rng(3).random((n, n))
    z = K.flooded(np.array([[100 - 0.5 * r - 3 * np.exp(-((c - n / 2) ** 2) / 8) for c in range(n)] for r in range(n)]) + rough, 1e-3, 1.0)
    cells = spark.createDataFrame([(r, c, float(z[r][c])) for r in range(n) for c in range(n)], "r int, c int, z double")
    for method, more in (("divides", {}), ("dreich", {"window_radius": 2.0, "tan_curv_threshold": 0.0, "n_connecting_nodes": 2})):
        got = C.channel_heads(cells, method, ncols=n, threshold=15, min_segment_length=4, **more).collect()
        assert all(0 <= h.r < n and 0 <= h.c < n for h in got)
    base = {(h.r, h.c) for h in C.channel_heads(cells, "divides", ncols=n, threshold=15, min_segment_length=4).collect()}
    same = C.channel_heads(cells, "divides", ncols=n, threshold=15, min_segment_length=4, filled=cells, direction=R.directions(R.receivers(cells, n), n)).collect()
    assert {(h.r, h.c) for h in same} == base
    with pytest.raises(C.NothingFound):
        C.channel_heads(cells, "dreich", ncols=n, threshold=15, min_segment_length=4, n_connecting_nodes=2, curvature=cells.select("r", "c", F.lit(-1.0).alias("curvature")))
    with pytest.raises(ValueError, match="grids differ"):
        C.channel_heads(cells, "divides", ncols=n, threshold=15, direction=cells.filter("r > 0").select("r", "c", F.lit(6).alias("d")))
    routed = C.route(cells, n)
    assert routed.agg(F.max("ncontrib")).first()[0] > n and C.route(cells, n, 1e-4).count() == n * n
    with pytest.raises(ValueError):
        C.channel_heads(cells, "other")


def test_profiler_writes_what_is_asked(spark, v, tmp_path):
    seg = C.link_network(v)
    got, plots = C.fluvial_profiler(v, seg, 1, values=("z",), outfile=str(tmp_path / "p"), outjson=str(tmp_path / "j"), plots=("LongProfile",))
    assert got.count() == 3 and plots["LongProfile"].first().x_label == "Distance from mouth [km]"
    assert [r._c0 for r in spark.read.option("sep", " ").csv(str(tmp_path / "p")).collect()][0] == "cat"
    assert {r.id for r in spark.read.json(str(tmp_path / "j/nodes")).collect()} == {0, 1, 3}
    C.fluvial_profiler(v, seg, 3, "upstream", ("z",), outjson=str(tmp_path / "k"))
    assert {r.id for r in spark.read.json(str(tmp_path / "k/nodes")).collect()} == {1, 2, 3}
    with pytest.warns(UserWarning, match="SlopeAccum"):
        assert C.plot_tables(got, ("SlopeAccum",)) == {}


def test_evolution_with_snapshots_and_network_cleaning(spark, tmp_path):
    cells = spark.createDataFrame([(r, c, float(r + c)) for r in range(5) for c in range(5)], "r int, c int, z double")
    assert {r.step for r in C.evolve(cells, 3, record_every=2).collect()} == {0, 2}
    nodes = spark.createDataFrame([(0, None), (1, 20.0)], "node long, z double")
    edges = spark.createDataFrame([(1, 0, 1, i, float(i), 20.0 - i) for i in range(30)], "src long, dst long, cat long, seq int, s double, z double")
    fixed, links = C.clean_network(nodes, edges, despike_window=3, n_iters=5, keep_fraction=0.2, outjson=str(tmp_path / "g"))
    assert {r.node: round(r.z, 4) for r in fixed.collect()} == {0: -9.0004, 1: 20.0} and links.count() == 6
    assert spark.read.json(str(tmp_path / "g/links")).count() == 1


def test_slope_area_needs_points(spark, v):
    with pytest.raises(C.NothingFound):
        C.channel_heads(v.withColumns({"s": F.col("y"), "A": F.lit(1.0)}), "slope_area")


def test_route_only_and_cleaning(spark, v):
    cells = spark.createDataFrame([(r, c, float(r + c)) for r in range(5) for c in range(5)], "r int, c int, z double")
    assert sorted(tuple(r)[2:] for r in C.evolve(cells).collect()) == sorted(tuple(r) for r in cells.collect())
    line = spark.createDataFrame([(1, i, float(i), 10.0 - i + (5 if i == 9 else 0)) for i in range(30)], "cat long, seq int, s double, z double")
    got = C.clean_coarsen(line, despike_window=3, n_iters=10, keep_fraction=0.2).collect()
    assert len(got) == 6


def test_a_raw_terrain_with_pits_gives_the_heads_of_the_filled_one(spark):
    n = 24
    z = [[100 - 0.5 * r - 3 * np.exp(-((c - n / 2) ** 2) / 8) + 1e-3 * ((r * 7 + c * 13) % 5) for c in range(n)] for r in range(n)]
    for r, c in ((6, 12), (14, 11), (18, 5), (9, 20)):
        z[r][c] -= 6.0
    cells = spark.createDataFrame([(r, c, float(z[r][c])) for r in range(n) for c in range(n)], "r int, c int, z double")
    more = {"ncols": n, "threshold": 15, "min_segment_length": 4}
    heads, filled, nodes = C.channel_heads(cells, "divides", with_routing=True, **more)
    same = C.channel_heads(filled, "divides", fill_dem=False, **more)
    assert {r.node for r in heads.collect()} == {r.node for r in same.collect()}
    assert nodes.filter("recv = node AND r > 0 AND r < 23 AND c > 0 AND c < 23").count() == 0 and filled.join(cells.withColumnRenamed("z", "z0"), ["r", "c"]).filter("z > z0 + 1").count() >= 4
    raw = R.receivers(cells, n)
    assert raw.filter("recv = node AND r > 0 AND r < 23 AND c > 0 AND c < 23").count() >= 4


def test_edges_end_at_their_nodes(spark):
    nodes = spark.createDataFrame([(1, 10.0), (2, 4.0)], "node long, z double")
    edges = spark.createDataFrame([(1, 2, 7, i, float(i), z) for i, z in enumerate([30.0, 8.0, 7.0, 6.0, 0.0])], "src long, dst long, cat long, seq int, s double, z double")
    ends = spark.createDataFrame([(7, 10.0, 4.0)], "cat long, left double, right double")
    got = {r.seq: r.z for r in K.clean_edges(edges, 2, 50.0, steps=3, ends=ends).collect()}
    assert (got[0], got[2], got[4]) == (10.0, 7.0, 4.0) and got[0] > got[1] > got[2] > got[3] > got[4]
    _, links = C.clean_network(nodes.union(spark.createDataFrame([(3, 1.0)], nodes.schema)), edges, keep_fraction=1.0, n_iters=3, despike_window=2, despike_k=50.0)
    assert all(4 <= r.z <= 10 for r in links.collect()) and links.count() == 5


def test_a_large_raster_evolves_in_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    z = rng.random((7, 6))
    cells = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(7) for c in range(6)], "r int, c int, z double")
    small = {(x.step, x.r, x.c): x.z for x in C.evolve(cells, 2, k=1e-3, record_every=1).collect()}
    monkeypatch.setattr(C, "RASTER_CELLS", 10)
    large = {(x.step, x.r, x.c): x.z for x in C.evolve(cells, 2, k=1e-3, record_every=1).collect()}
    assert set(large) == set(small) == {(s, r, c) for s in (0, 1) for r in range(7) for c in range(6)}
    assert max(abs(large[k] - small[k]) for k in small) < 1e-5
