from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.operators import divides as D
from thalweg.operators import metrics as M
from thalweg.plans.iterate import keep


def test_divide_metrics_of_both_sides(spark):
    lab = [[1, 1, 2], [1, 3, 3]]
    t = spark.createDataFrame([(r, c, lab[r][c]) for r in range(2) for c in range(3)], "r int, c int, lab int")
    hill = spark.createDataFrame([(0, 4.0, 2.0), (1, 6.0, 3.0), (2, 2.0, 1.0), (3, 0.0, 0.0), (4, 0.0, 0.0)], "node long, height double, dist double")
    got = {(r.n1, r.n2): r for r in M.divide_metrics(D.edges(t, 3), hill, 3).collect()}
    assert set(got) == {(1, 2), (1, 4), (2, 5), (3, 4)}
    assert (got[1, 2].hr, got[1, 2].fd, got[1, 2].dai) == (4.0, 2.0, 0.5) and got[1, 4].dai == 1.0
    assert got[3, 4].dai is None and got[3, 4].hr == 0.0 and got[2, 5].hr is None
    e = keep(D.edges(t, 3))
    by = M.metrics_by(M.divide_metrics(e, hill, 3), e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("ord")), "ord").first()
    assert (by.n, round(by.hr, 6)) == (3, round((4 + 3 + 0) / 3, 6))


def test_zonal_quantiles_are_exact_whatever_a_zones_size(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.choice([1, 1, 1, 1, 2, 3])), float(np.round(rng.normal(), 1))) for i in range(3000)] + [(3000, 9, 5.0), (3001, None, 1.0), (3002, 2, None), (3003, 2, float("nan"))]
    shares = [0.0, 0.05, 0.5, 0.93, 1.0]
    t = spark.createDataFrame(rows, "id long, zone int, x double").repartition(6)
    got = {(r.zone, r.share): (r.q, r.n) for r in M.zonal_quantiles(t, "zone", "x", shares, "id").collect()}
    for z in (1, 2, 3, 9):
        x = np.array([v for _, k, v in rows if k == z and v is not None and v == v])
        for s in shares:
            assert got[z, s][1] == len(x) and abs(got[z, s][0] - np.quantile(x, s)) < 1e-12
    assert len(got) == 20 and M.zonal_quantiles(t.limit(0), "zone", "x", shares, "id").count() == 0


def test_recession_times_and_width(spark):
    t = spark.createDataFrame([(1, 7, 3.0, 4.0, 2.0), (2, 7, 0.0, 4.0, 2.0), (3, 7, 1.0, 0.0, 2.0), (4, 7, None, None, 2.0), (5, 8, 5.0, 5.0, 1.0)], "node long, zone int, height double, dist double, k double")
    got = {r.node: r for r in M.recession_times(t, "k", "0.3", "1.5").collect()}
    assert abs(got[1].tau_adv - 4 * 0.3 / (2 * 0.6)) < 1e-12 and abs(got[1].tau_diff - 16 * 0.3 / (2 * 1.5)) < 1e-12
    assert abs(got[1].peclet - got[1].tau_diff / got[1].tau_adv) < 1e-12 and all(got[k].tau_adv is None for k in (2, 3, 4))
    p = {(r.zone, r.share): r for r in M.recession_priors(M.recession_times(t, "k"), "zone").collect()}
    assert len(p) == 6 and p[7, 0.5].n == 1 and p[8, 0.95].dist == 5.0
    assert sorted(map(tuple, M.width_function(t, "zone", 3.0).collect())) == [(7, 0, 1), (7, 1, 2), (8, 1, 1)]


def all_partitions(x, y, penalty, least):
    n, best = len(x), np.inf
    for m in range(n // least):
        for cuts in combinations(range(least, n - least + 1), m):
            ends = [0, *cuts, n]
            if min(np.diff(ends)) < least:
                continue
            rss = sum(((y[i:j] - np.polyval(np.polyfit(x[i:j], y[i:j], 1), x[i:j])) ** 2).sum() for i, j in zip(ends, ends[1:]))
            best = min(best, rss + penalty * len(ends) - penalty)
    return best


@pytest.mark.parametrize("least", [2, 3, 5])
def test_segments_equal_all_partitions(least):
    rng = np.random.default_rng(least)
    for _ in range(25):
        n = int(rng.integers(least, 14))
        x = np.cumsum(rng.random(n) + 0.1)
        y = np.where(np.arange(n) < n // 2, x, 4 * x) + rng.normal(0, 0.5, n)
        penalty = float(rng.choice([0.05, 0.5, 5.0]))
        got = M.segmented(x, y, penalty, least)
        assert [g[0] for g in got][0] == 0 and got[-1][1] == n - 1 and all(b[0] == a[1] + 1 for a, b in zip(got, got[1:]))
        assert all(g[1] - g[0] + 1 >= least for g in got)
        assert abs(sum(g[4] for g in got) + penalty * len(got) - all_partitions(x, y, penalty, least)) < 1e-6
    assert M.segmented(x[:1], y[:1], 1.0, 2) == []


def test_steepness_of_a_broken_profile(spark):
    rng = np.random.default_rng(1)
    chi = np.linspace(0, 20, 200)
    z = np.where(chi < 8, 3 * chi, 24 + 10 * (chi - 8)) + rng.normal(0, 0.05, 200)
    rows = [(1, 199 - i, float(chi[i]), float(z[i])) for i in range(200)] + [(2, 0, 1.0, 2.0), (2, 1, None, 3.0), (3, 0, 1.0, 5.0), (3, 1, 1.0, 5.0), (3, 2, 1.0, 5.0)]
    got = M.steepness(spark.createDataFrame(rows, "cat long, seq int, chi double, z double"), penalty=1.0, ref_area=4.0).orderBy("cat", "piece").collect()
    assert [(r.cat, r.piece) for r in got] == [(1, 0), (1, 1), (3, 0)]
    assert abs(got[0].ksn - 6) < 0.1 and abs(got[1].ksn - 20) < 0.1 and abs(got[0].chi_to - 8) < 0.3 and got[0].first > got[1].last and got[2].ksn == 0
    x = np.linspace(0, 50, 3000)
    assert len(M.segmented(x, np.cumsum(np.repeat([1.0, 3.0, 2.0], 1000)), 10.0)) == 3
