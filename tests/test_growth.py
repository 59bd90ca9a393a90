"""Work and results on inputs whose rows crowd or whose tables are large: what a query meets must not multiply."""

import random

from thalweg.operators import diagnostics as G
from thalweg.operators import evaluate as E


def joined(spark, run, node="Join", counted="number of output rows"):
    """(result of run, rows that joins, or other nodes, gave while it ran)."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    first = store.executionsCount()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    total = 0
    runs = store.executionsList()
    for k in range(runs.size()):
        if k < first:
            continue
        at = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for i in range(nodes.size()):
            if node in nodes.apply(i).name():
                for m in range(nodes.apply(i).metrics().size()):
                    metric = nodes.apply(i).metrics().apply(m)
                    if metric.name() == counted and (v := values.get(metric.accumulatorId())).isDefined():
                        total += int(v.get().replace(",", ""))
    return out, total


def crowd(spark, n, places, first=0):
    rnd = random.Random(n)
    rows = [(first + i, *rnd.choice(places)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double")


def plain(a, b, dist, fits):
    out = {}
    for i, x, y in a:
        near = [(dist(x - u, y - v), j) for j, u, v in b]
        if near and fits(min(near)[0]):
            out[i] = min(near)[1]
    return out


def test_points_at_one_place_do_not_multiply(spark):
    a, ta = crowd(spark, 700, [(0.0, 0.0), (3.0, 1.0), (400.0, 0.0)])
    b, tb = crowd(spark, 600, [(0.0, 1.0), (3.0, 2.0), (90.0, 0.0)], 1000)
    want = plain(a, b, lambda p, q: (p * p + q * q) ** 0.5, lambda d: d <= 40)
    got, rows = joined(spark, lambda: {r.id_a: r.id_b for r in E.nearest(ta, tb, 40.0).collect()})
    assert got == want and rows < 5000
    got, rows = joined(spark, lambda: E.match_quality(tb, ta, 40.0).first())
    assert (got.n_known, got.n_found, got.recall) == (700, 600, len(want) / 700) and rows < 10000
    want = plain(a, b, lambda p, q: (p / 30) ** 2 + (q / 50) ** 2, lambda d: d < 1)
    got, rows = joined(spark, lambda: {r.id_a: r.id_b for r in G.signature_match(ta, tb, {"x": 30.0, "y": 50.0}).collect()})
    assert got == want and rows < 5000


def test_crowded_places_are_met_in_small_squares(spark):
    rnd = random.Random(3)
    spots = [(rnd.random() * 50, rnd.random() * 50) for _ in range(900)] + [(rnd.random() * 900, rnd.random() * 900) for _ in range(60)]
    a, ta = crowd(spark, 500, spots[::2])
    b, tb = crowd(spark, 1500, spots[1::2], 1000)
    got, rows = joined(spark, lambda: {r.id_a: r.id_b for r in E.nearest(ta, tb, 40.0).collect()})
    assert got == plain(a, b, lambda p, q: (p * p + q * q) ** 0.5, lambda d: d <= 40) and rows < 60000
    got, rows = joined(spark, lambda: {r.id_a: r.id_b for r in G.signature_match(ta, tb, {"x": 30.0, "y": 50.0}).collect()})
    assert got == plain(a, b, lambda p, q: (p / 30) ** 2 + (q / 50) ** 2, lambda d: d < 1) and rows < 60000


def test_distance_to_channel_makes_no_pairs(spark):
    rnd = random.Random(5)
    cells = [(r, c) for r in range(-3, 37) for c in range(50) if rnd.random() < 0.9]
    nodes = spark.createDataFrame([(1000 * r + c, r, c) for r, c in cells], "node long, r int, c int")
    assert G.distance_to_channel(nodes, nodes.limit(0)).count() == 0
    for share in (0.002, 0.05, 0.5):
        channel = [x for x in cells if rnd.random() < share] or cells[-1:]
        ch = spark.createDataFrame(channel, "r int, c int")
        got, rows = joined(spark, lambda: {r.node: r.d for r in G.distance_to_channel(nodes, ch).collect()})
        assert got == {1000 * r + c: min(((r - u) ** 2 + (c - v) ** 2) ** 0.5 for u, v in channel) for r, c in cells}
        assert rows <= len(channel)


def test_x19_is_not_met_in_growing_squares(spark, monkeypatch):
    from thalweg import catalog

    monkeypatch.setattr(E, "nearest_of_all", lambda *a: 1 / 0)
    assert catalog.QUERIES["x19_distance_to_channel"](spark, "/root/testdata/sf0.001").count() == 361


def test_receivers_send_a_cell_little_more_than_once(spark):
    from thalweg.operators import routing as R

    rnd = random.Random(7)
    z = {(r, c): float(rnd.randrange(40)) for r in range(-5, 300) for c in range(20) if rnd.random() < 0.9}
    cells = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "r int, c long, z double")
    t = R.receivers(cells, 20)
    got, rows = joined(spark, lambda: t.collect(), "Exchange", "shuffle records written")
    assert rows < 1.2 * len(z) and [x.dataType.simpleString() for x in t.schema] == ["bigint", "int", "bigint", "double", "bigint", "int"]
    want = {}
    for (r, c), v in z.items():
        drops = [(w * (v - z[r + i, c + j]), -k) for k, (i, j, w) in enumerate(R.RING) if (r + i, c + j) in z]
        slope, k = max(drops, default=(0.0, 0))
        i, j, w = R.RING[-k]
        want[r, c] = (r * 20 + c, v, (r + i) * 20 + c + j, 1 if w == 1 else 2) if slope > 0 else (r * 20 + c, v, r * 20 + c, 0)
    assert {(x.r, x.c): (x.node, x.z, x.recv, x.flc) for x in got} == want
