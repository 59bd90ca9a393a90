import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.operators import diagnostics as G
from thalweg.operators import divides as D
from thalweg.operators import evaluate as E
from thalweg.operators import heads as H
from thalweg.operators import kernels as K
from thalweg.operators import quantiles as Qu
from thalweg.operators import routing as R
from thalweg.operators import slopearea as A
from thalweg.plans.iterate import keep


def cells(spark, z):
    return spark.createDataFrame([(r, c, float(v)) for r, row in enumerate(z) for c, v in enumerate(row) if v is not None], "r int, c int, z double")


def brute(z):
    rows, cols = z.shape
    recv = np.arange(z.size)
    for r in range(rows):
        for c in range(cols):
            best = 0.0
            for dr, dc, w in R.RING:
                i, j = r + dr, c + dc
                if 0 <= i < rows and 0 <= j < cols and w * (z[r, c] - z[i, j]) > best:
                    best, recv[r * cols + c] = w * (z[r, c] - z[i, j]), i * cols + j
    area = np.zeros(z.size, int)
    for n in range(z.size):
        while True:
            area[n] += 1
            if recv[n] == n:
                break
            n = recv[n]
    return recv, area


def test_routing_equals_brute_force(spark):
    z = np.random.default_rng(5).random((9, 11))
    got = R.accumulate(R.receivers(cells(spark, z), 11)).orderBy("node").collect()
    recv, area = brute(z)
    assert [r.recv for r in got] == recv.tolist() and [r.ncontrib for r in got] == area.tolist()
    back = R.receivers_from_directions(R.directions(R.receivers(cells(spark, z), 11), 11).join(cells(spark, z), ["r", "c"]), 11).orderBy("node").collect()
    assert [r.recv for r in back] == recv.tolist()


def test_ramp_flows_south(spark):
    z = [[100 - r] * 8 for r in range(8)]
    got = {(r.r, r.c): r for r in R.accumulate(R.receivers(cells(spark, z), 8)).collect()}
    assert all(got[7, c].ncontrib == 8 and got[0, c].fd == 7.0 for c in range(8))


def test_loops_and_odd_codes(spark):
    loop = spark.createDataFrame([(0, 0, 1.0, 8), (0, 1, 1.0, 4)], "r int, c int, z double, d int")
    with pytest.raises(R.FlowLoop):
        R.accumulate(R.receivers_from_directions(loop, 2))
    odd = spark.createDataFrame([(0, 0, 1.0, 8), (0, 1, 1.0, 8), (1, 0, 1.0, 8), (1, 1, 1.0, 99), (1, 2, 1.0, 0)], "r int, c int, z double, d int")
    assert {r.node: r.recv for r in R.receivers_from_directions(odd, 3).collect()} == {0: 1, 1: 1, 3: 4, 4: 4, 5: 5}


def test_fill(spark):
    z = [[5, 5, 5, 5, 5], [5, 4, 4, 4, 5], [5, 4, 0, 4, 3], [5, 4, 4, 4, 5], [5, 5, 5, 5, 5]]
    got = {(r.r, r.c): r.filled for r in R.fill_flat(cells(spark, z)).collect()}
    assert got[2, 2] == 4 and got[0, 0] == 5 and got[1, 1] == 4
    flat = {(r.r, r.c): r.filled for r in K.fill_ordered(cells(spark, z).withColumn("raster_id", F.lit(1).cast("long")), 0.0).collect()}
    assert flat == got
    z = np.random.default_rng(2).random((12, 12)) * 5
    a = K.flooded(z, 0.0, 1.0)
    one = {(r.r, r.c): np.float32(r.filled) for r in R.fill_flat(cells(spark, z)).collect()}
    assert all(one[i] == a[i] for i in one)
    assert (K.flooded(z, 0.01, 1.0) >= a - 1e-6).all()


def one_by_one(z, slope, size):
    """The fill by taking the lowest, then earliest, of a plain list each time."""
    out, here = z.astype(np.float32), {tuple(i) for i in np.argwhere(~np.isnan(z)).tolist()}
    near = lambda r, c: [((r + dr, c + dc), w) for dr, dc, w in R.RING]
    todo = [(out[i], k, i) for k, i in enumerate(sorted(here)) if any(j not in here for j, _ in near(*i))]
    left, k = here - {i for *_, i in todo}, len(here)
    while todo:
        todo.remove(low := min(todo))
        for j, w in near(*low[2]):
            if j in left:
                left.remove(j)
                if out[j] <= low[0]:
                    out[j] = low[0] + np.float32(slope * size * (1.0 if w == 1.0 else K.DIAGONAL_RISE))
                todo.append((out[j], k, j))
                k += 1
    return out


def test_floods_equal_one_by_one():
    rng = np.random.default_rng(7)
    for k in range(12):
        z = rng.integers(0, 6, (9, 10)).astype(float) if k % 2 else rng.random((8, 11)) * 3
        z[rng.random(z.shape) < 0.05] = np.nan
        for slope in (0.0, 0.01):
            assert np.array_equal(K.flooded(z, slope, 2.0), one_by_one(z, slope, 2.0), equal_nan=True)


@pytest.mark.parametrize("slope", [0.0, 0.02])
def test_tiles_fill_as_the_whole(spark, slope):
    rng = np.random.default_rng(3)
    z = rng.random((23, 31)) * 4
    z[5:9, 11:14] = np.nan
    z[10:20, 3:28] -= 3.5  # a lake over many tiles
    df = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(23) for c in range(31) if z[r, c] == z[r, c]], "r int, c int, z double")
    got = {(x.r, x.c): np.float32(x.filled) for x in K.fill(df, slope, tile=6).collect()}
    want = K.flooded(z, slope, 1.0)
    assert len(got) == df.count() and all(abs(v - want[i]) <= 1e-5 for i, v in got.items())


def test_gradient_fill_of_groups(spark):
    df = spark.createDataFrame([(g, r, c, 0.0 if (r, c) == (2, 2) else 5.0 + g) for g in (1, 2) for r in range(5) for c in range(5)], "g long, r int, c int, z double")
    got = {(x.g, x.r, x.c): x.filled for x in K.fill(df, 0.0, group="g", tile=2).collect()}
    assert got[1, 2, 2] == 6.0 and got[2, 2, 2] == 7.0 and len(got) == 50


def test_links_of_a_y(spark):
    z = [[100.0] * 5 for _ in range(6)]
    for r, c, v in ((0, 0, 9), (1, 1, 8), (2, 2, 6), (3, 2, 5), (4, 2, 4), (5, 2, 3), (0, 4, 9), (1, 3, 8)):
        z[r][c] = float(v)
    n = keep(R.accumulate(R.receivers(cells(spark, z), 5)))
    at, numbered = R.links(n, spark.createDataFrame([(0,), (4,)], "node long"))
    got = {r.cat: r for r in numbered.collect()}
    assert {c: r.tostream for c, r in got.items()} == {1: 3, 2: 3, 3: 0} and got[1].end == 12
    assert sorted(r.node for r in at.join(numbered.filter("cat = 3"), "link").collect()) == [12, 17, 22, 27]


def test_divide_networks(spark):
    lab = [[1, 1, 2, 2]] * 2 + [[1, 1, 3, 3]] * 2
    t = spark.createDataFrame([(r, c, v) for r, row in enumerate(lab) for c, v in enumerate(row)], "r int, c int, lab int")
    e = keep(D.edges(t, 4))
    deg = keep(D.corners(e))
    assert sorted(r.corner for r in deg.filter("degree >= 3").collect()) == [12] and deg.filter("degree = 1").count() == 3
    ends = keep(D.segment_ends(D.segments(e), deg))
    assert ends.count() == 3 and {r.ord for r in D.order(ends, deg).collect()} == {1}


@pytest.mark.parametrize(("scheme", "top"), [("topo", 2), ("strahler", 2), ("shreve", 2)])
def test_order_grows_inward(spark, scheme, top):
    # an H: two tips on either side of one inner segment
    e = spark.createDataFrame([(1, 3), (2, 3), (3, 4), (4, 7), (7, 5), (7, 6)], "a long, b long")
    deg = keep(D.corners(e))
    got = D.order(keep(D.segment_ends(D.segments(e), deg)), deg, scheme).collect()
    assert sorted(r.ord for r in got) == [1, 1, 1, 1, top] and max(r.dd for r in got) == 3.0


def test_crossing_passes_through(spark):
    w = 5
    mid = 2 * w + 2
    e = spark.createDataFrame([(mid, mid - w), (mid, mid + w), (mid, mid - 1), (mid, mid + 1)], "a long, b long")
    assert D.corners(e).filter("degree >= 3").count() == 1
    s = D.split_crossings(e, spark.createDataFrame([(mid, 1)], "corner long, fx int"), w - 1)
    assert D.corners(s).filter("degree >= 3").count() == 0 and D.segments(keep(s)).select("seg").distinct().count() == 2


def test_chi_split_equals_plain_search(spark):
    rng = np.random.default_rng(3)

    def fit(x, y):
        if ((x - x.mean()) ** 2).sum() == 0:
            return 0.0, 2.0
        m = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
        res = y.mean() + m * (x - x.mean()) - y
        sst = ((y - y.mean()) ** 2).sum()
        return (1 - (res**2).sum() / sst if sst > 0 else 0.0), (np.diff(res) ** 2).sum() / ((res**2).sum() or 1e-10)

    rows, want = [], {}
    for p in range(25):
        n = int(rng.integers(15, 60))
        chi, z = np.sort(rng.random(n) * 9)[::-1], np.cumsum(rng.random(n))[::-1]
        rows += [(p, i, float(chi[i]), float(z[i])) for i in range(n)]
        if n >= 20:
            scores = [fit(chi[h:], z[h:])[0] - (fit(chi[:h], z[:h])[1] - 2) / 2 for h in range(10, n - 9)]
            want[p] = 10 + int(np.argmax(scores))
    got = {r.profile: r.i for r in H.chi_split(spark.createDataFrame(rows, "profile long, i int, chi double, z double")).collect()}
    assert got == want


def test_heads_lie_on_an_incised_valley(spark):
    nr = nc = 24
    z = [[100 - 0.5 * r - 3 * np.exp(-((c - nc / 2) ** 2) / 8) for c in range(nc)] for r in range(nr)]
    n = keep(R.accumulate(R.receivers(cells(spark, z), nc)))
    heads = H.first_order_heads(n, 15, 4).collect()
    assert heads and all(0 <= h.r < nr and 0 <= h.c < nc for h in heads)
    with pytest.raises(ValueError):
        H.first_order_heads(n, 15, 4, rule="other")


def test_curvature_window(spark):
    with pytest.raises(ValueError):
        R.curvature_kernels(7.0, 10.0)
    bowl = [[(r - 10) ** 2 * 0.01 + c * 0.5 for c in range(20)] for r in range(20)]
    got = {(r.r, r.c): r.curvature for r in R.tangential_curvature(cells(spark, bowl), 2.0, 1.0).collect()}
    assert got[0, 0] is None and abs(got[10, 10] - 0.02 / (1 + 0.25) ** 0.5) < 1e-6


def run(z, k, steps, **more):
    it = K.evolution(z, k, fixed=K.edges_of(z), **more)
    for _ in range(steps):
        z = next(it)
    return z


def test_evolution_nears_steady_state(spark):
    rng = np.random.default_rng(1)
    z = rng.random((15, 15))
    z[[0, -1], :] = z[:, [0, -1]] = 0
    a = run(z, 1e-3, 150, cellsize=10.0)
    b = run(a, 1e-3, 1, cellsize=10.0)
    assert np.abs(b - a).max() / a.max() < 0.05 and (a >= 0).all()
    df = cells(spark, z).withColumn("raster_id", F.lit(4).cast("long"))
    got = K.evolve(df, 21, record_every=10, k=1e-3, cellsize=10.0)
    assert sorted(r.step for r in got.select("step").distinct().collect()) == [0, 10, 20]
    last = {(r.r, r.c): r.z for r in got.filter("step = 20").collect()}
    want = run(z, 1e-3, 21, cellsize=10.0)
    assert all(abs(last[i] - want[i]) < 1e-4 for i in last)


def test_masked_boundary_and_rates_by_cell(spark):
    z = np.random.default_rng(2).random((8, 8)) + 10.0 * np.arange(8, 0, -1)[:, None]  # no pits
    df = cells(spark, z).withColumn("raster_id", F.lit(1).cast("long")).withColumn("fixed", F.col("r") == 7).withColumn("k", F.when(F.col("c") < 4, 1e-3).otherwise(0.0))
    got = {(r.r, r.c): r.z for r in K.evolve(df, 5, "mask", uplift=1e-3).collect()}
    assert all(got[7, c] == np.float32(z[7, c]) for c in range(8))
    assert all(abs(got[r, c] - (z[r, c] + 5)) < 1e-4 for r in range(7) for c in range(4, 8)) and got[6, 1] < z[6, 1] + 5
    with pytest.raises(ValueError):
        K.evolve(df.drop("fixed"), 5, "mask")


@pytest.mark.parametrize("n", [1.0, 0.7, 2.0])
def test_incision_solves_its_equation(n):
    rng = np.random.default_rng(5)
    drops, erosion = rng.random(200) * 50, rng.random(200) * 10
    drops[:5] = 0
    for d, e, got in zip(drops, erosion, K.lowered(drops, erosion, n)):
        lo, hi = 0.0, d
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if mid + e * mid**n < d else (lo, mid)
        assert abs(got - lo) < 1e-4


def test_a_step_of_evolution_node_by_node():
    rng = np.random.default_rng(8)
    z = rng.random((9, 9)) * 5
    fixed = K.edges_of(z)
    got = next(K.evolution(z, 1e-3, uplift=2e-3, dt=100.0, fixed=fixed, cellsize=3.0))
    up = z + np.where(fixed, 0, 0.2)
    full = K.flooded(up, 1e-4, 3.0)
    recv, area = brute(full)
    want, done = up.ravel().copy(), set()

    def settle(i):
        to = recv[i]
        if i in done or to == i or fixed.ravel()[i]:
            return
        settle(to)
        reach = 3.0 * (1.0 if abs(to - i) in (1, 9) else 2**0.5)
        f = 1e-3 * 100 * (area[i] * 9.0) ** 0.5 / reach
        want[i] = max(want[to], (want[i] + f * want[to]) / (1 + f)) if want[i] > want[to] else want[to]
        done.add(i)

    for i in range(81):
        settle(i)
    assert np.allclose(got.ravel(), want, atol=1e-9)


def point_by_point(y, window, k):
    n, out = len(y), list(y)
    if n < 3:
        return out
    around = lambda i: range(max(0, i - window), min(n, i + window + 1))
    bad = []
    for i in range(1, n - 1):
        near = [y[j] for j in around(i)]
        mad = np.median(np.abs(near - np.median(near)))
        if mad > 0 and abs(0.6745 * (y[i] - np.median(near)) / mad) > k:
            bad.append(i)
    for i in bad:
        sound = [out[j] for j in around(i) if j not in bad]
        out[i] = np.median(sound or [out[j] for j in around(i)])
    return out


def test_despiking_equals_point_by_point():
    rng = np.random.default_rng(9)
    for k in range(80):
        y = rng.normal(0, 1, rng.integers(0, 40)).round(1) * (1 + 9 * (rng.random() < 0.5))
        for window, limit in ((1, 0.3), (2, 3.5), (5, 1.0), (100, 2.0)):
            assert np.allclose(K.despike(y, window, limit), point_by_point(y, window, limit)), (k, window)


def test_cleaning():
    y = np.array([1.0, 1.1, 9.0, 1.2, 1.3, 1.2, 1.4])
    assert K.despike(y)[2] < 2 and K.despike(y[:2]).tolist() == y[:2].tolist()
    assert K.diffuse(np.array([5.0]), 1.0, 3.0).tolist() == [2.0]
    assert K.diffuse(np.array([9.0, 5.0, 9.0]), 1.0, 3.0, 0.35, 1).tolist() == [1.0, 5 + 0.35 * (2 - 5), 3.0]
    assert np.allclose(K.diffuse(np.array([9.0, 5.0, -4.0, 7.0, 1.0]), 0.0, 4.0), [0, 1, 2, 3, 4], atol=1e-6)


def test_walks_closures_and_the_stack_equal_plain_ones(spark):
    z = np.random.default_rng(11).random((9, 12))
    n = keep(R.accumulate(R.receivers(cells(spark, z), 12)))
    recv, area = brute(z)

    def way(i):
        out = [i]
        while recv[out[-1]] != out[-1]:
            out.append(int(recv[out[-1]]))
        return out

    got = {}
    for x in R.walk_down(n, n.filter("node % 5 = 0"), 4).collect():
        got.setdefault(x.start, {})[x.i] = x.node
    assert got == {i: dict(enumerate(way(i)[:5])) for i in range(0, 108, 5)}
    pairs = {(x.top, x.node) for x in R.ancestor_closure(n, n.filter("node % 3 = 1")).collect()}
    assert pairs == {(t, i) for i in range(108) for t in way(i) if t % 3 == 1}
    limited = {(x.start, x.node) for x in R.walk_down(n, n, most_area=6).collect()}
    assert limited == {(i, t) for i in range(108) for k, t in enumerate(way(i)) if k == 0 or area[t] <= 6}
    stack = [x.node for x in G.ordered_stack(n).orderBy("place").collect()]
    seen, todo = [], [int(i) for i in reversed(np.flatnonzero(recv == np.arange(108)))]
    while todo:
        i = todo.pop()
        seen.append(i)
        todo += [int(d) for d in reversed(np.flatnonzero(recv == i)) if d != i]
    assert stack == seen


def test_valleys_equal_walks_one_after_another(spark):
    rng = np.random.default_rng(4)
    z = np.add.outer(np.arange(22)[::-1] * 2.0, np.zeros(22)) + rng.random((22, 22)) * 3
    n = keep(R.accumulate(R.receivers(cells(spark, z), 22)))
    gate = {i: None if i % 29 == 0 else bool(rng.random() < 0.7) for i in range(484)}
    gates = spark.createDataFrame(list(gate.items()), "node long, gate boolean")
    net = {x.node: x for x in H.stream_network(n, 5).collect()}
    donors = {i: [d for d in net if net[d].recv == i and d != i] for i in net}
    for i, x in net.items():
        below = sorted((net[d].ord for d in donors[i]), reverse=True)
        assert x.ord == (1 if not below else below[0] + (below[1:2] == below[:1])) and x.junction == (len(donors[i]) != 1 or x.recv == i)
    want, seen = set(), set()
    for s in sorted(i for i in net if not donors[i]):
        at, streak = s, 0
        while gate[at] is not None:
            seen.add(at)
            streak = streak + 1 if gate[at] else 0
            if streak > 3:
                end = at
                while net[end].recv != end and net[net[end].recv].ord <= net[end].ord:
                    end = net[end].recv
                if net[end].recv != end:
                    up = end
                    while not net[up].junction:
                        (up,) = donors[up]
                    want.add((end, up))
                break
            if net[at].recv in seen:
                break
            at = net[at].recv
    got = {(x.node, x.junction) for x in H.valleys(n.join(gates, "node"), "gate", 5, 3).collect()}
    assert got == want and want


def slow32(x, y, h):
    f = np.float32

    def fit(x, y):
        add = lambda v: np.cumsum(v, dtype=f)[-1]
        a, b, c, d, e = add(x * x), add(x), f(len(x)), add(x * y), add(y)
        rows = sorted([(a, b, d), (b, c, e)], key=lambda r: -abs(r[0]))
        (p, q, r), (s, t, u) = rows
        m = f(s / p)
        v = f(f(u - f(r * m)) / f(t - f(m * q)))
        w = f(f(r - f(v * q)) / p)
        miss = ((w * x + v).astype(f) - y).astype(f)
        miss[np.abs(miss) < f(1e-12)] = 0
        err, turn = add(miss * miss), add(np.diff(miss) ** 2)
        return f(f(1) - err / add(((y - f(e / c)) ** 2).astype(f))), f(turn / (err or f(1e-10)))

    return f(fit(x[h:], y[h:])[0] - f((fit(x[:h], y[:h])[1] - f(2)) / f(2)))


def test_single_precision_scores_equal_plain_sums(spark):
    rng = np.random.default_rng(6)
    for _ in range(30):
        n = int(rng.integers(10, 70))
        x = np.sort(rng.random(n).astype(np.float32) * 30)[::-1].copy()
        y = (x * 2 + rng.normal(0, 1, n)).astype(np.float32)
        splits = np.arange(4, n - 3)
        assert np.array_equal(H.scores32(x, y, splits), np.array([slow32(x, y, h) for h in splits], np.float32))
    step = H.chi32(np.array([4, 5, 900]), np.array([False, True, False]), 1000.0, 0.5, 1.0)
    assert step[2] == 0 and step.dtype == np.float32 and np.isclose(step[1], 2**0.5 * (1000 / 5) ** 0.5) and np.isclose(step[0] - step[1], 250**0.5)
    p = spark.createDataFrame([(1, i, 100 + i, float(20 - i if i > 8 else 12 - 0.1 * i), 1 + 3 * i, 1) for i in range(20)], "profile long, i int, node long, z double, ncontrib long, flc int")
    assert H.single_precision_heads(p, 4).count() <= 1 and H.single_precision_heads(p, 4, "uppermost").count() == 1
    assert H.single_precision_heads(p.filter("i < 5"), 4, "uppermost").first().node == 100 and H.single_precision_heads(p.filter("i < 5"), 4).count() == 0


def test_profiles_go_on_below_their_end(spark):
    nr = nc = 24
    z = [[100 - 0.5 * r - 3 * np.exp(-((c - nc / 2) ** 2) / 8) for c in range(nc)] for r in range(nr)]
    n = keep(R.accumulate(R.receivers(cells(spark, z), nc)))
    found = keep(H.first_order_valleys(n, 15))
    ends = found.select(F.col("junction").alias("node")).distinct().withColumn("end", F.col("node"))
    short = {x.profile: x.n for x in H.profiles(n, ends).groupBy("profile").agg(F.count("*").alias("n")).collect()}
    long = {x.profile: x.n for x in H.profiles(n, ends, min_nodes=9).groupBy("profile").agg(F.count("*").alias("n")).collect()}
    assert set(short) == set(long) and any(short[k] < 9 for k in short) and all(long[k] >= short[k] and (long[k] == short[k] or long[k] <= 9) for k in long)
    for more in ({"extend_to_junction": True}, {"min_profile_nodes": 9, "rule": "uppermost"}, {"precision": 32, "min_profile_nodes": 9}):
        assert all(0 <= h.r < nr for h in H.heads_from_valleys(n, found, 15, 4, **more).collect())
    with pytest.raises(ValueError):
        H.heads_from_valleys(n, found, 15, rule="other")


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(12)
    rows = [(int(g), float(x)) for g, x in zip(rng.integers(0, 3, 5000), np.round(rng.lognormal(0, 3, 5000), 2))] + [(7, 1.0), (8, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "g int, x double")
    shares = [0.0, 0.05, 0.333, 0.5, 0.95, 1.0]
    got = Qu.exact_quantiles(df, "x", shares, "g")
    ok = [(g, x) for g, x in rows if x is not None and x == x]
    assert set(got) == {0, 1, 2, 7}
    for g in got:
        assert np.allclose(got[g], np.quantile([x for h, x in ok if h == g], shares), rtol=1e-12)
    assert np.allclose(Qu.exact_quantiles(df, "x", shares)[None], np.quantile([x for _, x in ok], shares), rtol=1e-12) and Qu.exact_quantiles(df.limit(0), "x", [0.5]) == {}


def test_sticks_and_tents():
    x = np.linspace(1, 5, 18)
    k, theta, h, fit, edge, ok = A.stick(x, -1 - 0.5 * np.maximum(0, x - 3.02))
    assert abs(k - 3.02) < 0.1 and abs(theta - 0.5) < 0.05 and ok and fit > 0.9 and edge > 0.4 and A.stick(x[:5], x[:5]) is None
    assert not A.stick(x, -0.5 * x)[-1]
    top, fit, theta = A.peak(x, 2 - np.abs(x - x[7]))
    assert top == x[7] and fit > 0.99 and abs(theta - 1) < 1e-9 and A.peak(x, x) is None and A.peak(x[:6], x[:6]) is None
    rng = np.random.default_rng(1)
    la = rng.random(4000) * 3.5 + 1.5
    star, theta = A.stick_gate(la, -1 - 0.5 * np.maximum(0, la - 3) + rng.normal(0, 0.05, 4000))
    assert abs(star - 3) < 0.15 and abs(theta - 0.5) < 0.1 and A.stick_gate(la[:10], la[:10]) is None


def test_power_by_wave_number(spark):
    n = 16
    wave = [[np.cos(2 * np.pi * 3 * c / n) for c in range(n)] for _ in range(n)]
    rows = [(b, r + 5, c, float(wave[r][c] if b == 1 else r)) for b in (1, 2) for r in range(n) for c in range(n) if b == 1 or (r, c) != (3, 3)]
    got = {(x.block, x.k): x.power for x in E.radial_spectrum(spark.createDataFrame(rows, "block int, r int, c int, z double")).collect()}
    assert {b for b, _ in got} == {1} and max(got, key=got.get) == (1, 3)
    z = (np.array(wave) - np.mean(wave)) * np.outer(np.hanning(n), np.hanning(n))
    f = lambda u, v: abs(sum(z[r, c] * np.exp(-2j * np.pi * (u * r + v * c) / n) for r in range(n) for c in range(n))) ** 2
    at = [(u, v) for u in range(-8, 8) for v in range(-8, 8) if round(np.hypot(u, v)) == 2]
    assert np.isclose(got[1, 2], np.mean([f(u, v) for u, v in at]))
    t = spark.createDataFrame([(1, k, float(k) ** -3) for k in range(1, 30)], "block int, k int, power double")
    assert np.isclose(E.spectral_slope(t, 2, 20).first().alpha, 3.0)


def test_quantiles_end_with_infinite_and_extreme_values(spark):
    from thalweg.operators.quantiles import exact_quantiles

    inf = float("inf")
    for values in ([*range(10), inf], [-inf, *range(10), inf, inf], [inf, inf], [-inf], [-1.7e308, 1.7e308, 0.0, 1.0, -3.0], [0.0, 5e-324, 1e-323], [1.0, None, float("nan"), 3.0]):
        t = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
        shares = [0.0, 0.25, 0.5, 0.77, 1.0]
        kept = sorted(float(v) for v in values if v is not None and v == v)
        got = exact_quantiles(t, "x", shares)[None]
        for s, g in zip(shares, got):
            p = s * (len(kept) - 1)
            a, b = kept[math.floor(p)], kept[math.ceil(p)]
            assert g == a if a == b or p == int(p) else g == a + (p - math.floor(p)) * (b - a) or g != g


def test_quantiles_of_many_values_need_few_passes(spark):
    from thalweg.operators import quantiles as U

    t = spark.range(300_000).selectExpr("rand(5) * 1000 - 400 AS x", "id % 3 AS g")
    t = spark.createDataFrame(t.toPandas())
    got, pdf = U.exact_quantiles(t, "x", [0.05, 0.5, 0.95], "g"), t.toPandas()
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g], np.quantile(part.x, [0.05, 0.5, 0.95]), rtol=0, atol=1e-12)


def test_peak_equals_a_fit_a_peak():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(5, 16))
        x, y = np.sort(rng.normal(3, 1, n)), rng.normal(0, 0.3, n)
        y = y - np.abs(x - x[n // 2]) * rng.uniform(0, 1)
        tried = []
        for p in range(2, n - 2):
            up, down = np.polyfit(x[:p + 1], y[:p + 1], 1), np.polyfit(x[p:], y[p:], 1)
            if up[0] > A.TENT_RISE and down[0] < A.TENT_FALL:
                tried.append((((y[:p + 1] - np.polyval(up, x[:p + 1])) ** 2).sum() + ((y[p + 1:] - np.polyval(down, x[p + 1:])) ** 2).sum(), x[p], -down[0]))
        line = ((y - np.polyval(np.polyfit(x, y, 1), x)) ** 2).sum()
        want = min(tried) if tried and n >= 7 else None
        got = A.peak(x, y)
        if want is None or 1 - want[0] / line < A.TENT_FIT:
            assert got is None
        else:
            assert np.allclose(got, (want[1], 1 - want[0] / line, want[2]))


def test_the_hull_of_many_points_is_merged_from_partitions(spark, monkeypatch):
    monkeypatch.setattr(E, "HULLS", 3)
    rng = np.random.default_rng(3)
    xy = rng.normal(0, 100, (20_000, 2)).round(1)
    t = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double").repartition(10)
    corners = E.hull_corners(t).first().corners
    want = E.hull([tuple(p) for p in xy.tolist()])
    assert {(p.x, p.y) for p in corners} == set(want) and len(corners) < 60
    assert E.within_hull(t, t).count() == 20_000
    inside = {r.id for r in E.within_hull(t, t.filter("abs(x) < 50 AND abs(y) < 50"), 10.0).collect()}
    ring = E.hull([tuple(p) for p in xy.tolist() if abs(p[0]) < 50 and abs(p[1]) < 50])
    assert inside == {r.id for r in E.within_hull(t, ring, 10.0).collect()} and len(inside) > 100
    assert E.within_hull(t, t.limit(2)).count() == E.within_hull(t, t.limit(0)).count() == 0


def test_long_profiles_split_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    n = 6000
    chi, z = np.sort(rng.random(n).astype(np.float32) * 50)[::-1].copy(), np.cumsum(rng.random(n).astype(np.float32))[::-1].copy()
    splits = np.arange(10, n - 9)[::40]
    tracemalloc.start()
    got = H.scores32(chi, z, splits)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6 and np.array_equal(got, np.concatenate([H._scores32(chi, z, splits[k:k + 1]) for k in range(len(splits))]), equal_nan=True)


def test_distinct_labels_across_tiles(spark):
    rng = np.random.default_rng(9)
    lab = rng.integers(-1, 4, (13, 11))
    rows = [(r, c, int(lab[r, c])) for r in range(13) for c in range(11) if (r + c) % 7]
    there = {(r, c): v for r, c, v in rows}
    got = {(x.r, x.c): x.n for x in E.distinct_near(spark.createDataFrame(rows, "r int, c int, lab int"), "lab", 2).collect()}
    assert got == {(r, c): len({there[i, j] for i in range(r - 2, r + 3) for j in range(c - 2, c + 3) if (i, j) in there}) for r, c in there}


def test_chains_meet_in_tiles_and_only_pieces_across_rims_go_round(spark, monkeypatch):
    import numpy as np

    w, r = 600, np.random.default_rng(3)
    # rows of corners, cut here and there: chains within a tile and across several, and an edge by itself
    runs = [(k * 8 * w + 3, [j for j in range(590) if r.random() > 0.004]) for k in range(6)]
    edges = [(a + j, a + j + 1) for a, js in runs for j in js]
    want, seg = {}, None
    for a, b in edges:
        seg = want.get((a - 1, a), a * (1 << 31) + b)
        want[a, b] = seg
    rounds, keep = [], D.keep

    def counted(df, name="step"):
        out = keep(df, name)
        if name == "seg":
            rounds.append(out.count())
        return out

    monkeypatch.setattr(D, "keep", counted)
    e = spark.createDataFrame([x if k % 3 else x[::-1] for k, x in enumerate(edges)], "a long, b long")
    assert {(x.a, x.b): x.seg for x in D.segments(e, w).collect()} == want
    assert max(rounds) < len(edges) / 20
    assert {(x.a, x.b): x.seg for x in D.segments(e).collect()} == want
