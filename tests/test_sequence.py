import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thalweg.operators import sequence as S
from thalweg.operators import slopearea as A


def frame(spark, s, **cols):
    return spark.createDataFrame([(1, i, float(x), *(float(c[i]) if c[i] is not None else None for c in cols.values())) for i, x in enumerate(s)], "cat long, seq int, s double" + "".join(f", {k} double" for k in cols))


def test_densify(spark):
    got = S.densify(frame(spark, [0, 10], z=[0, 100]), 2.5, ["z"]).orderBy("seq").collect()
    assert [(r.s, r.z) for r in got] == [(0, 0), (2.5, 25), (5, 50), (7.5, 75), (10, 100)]
    got = S.densify(frame(spark, [0, 5, 5, 10], z=[0, 5, 99, 10]), 2.5, ["z"]).orderBy("seq").collect()
    assert [r.z for r in got] == [0, 2.5, 5, 7.5, 10]
    assert S.densify(frame(spark, [3, 3], z=[1, 2]), 1.0, ["z"]).count() == 1


def test_slope(spark):
    assert [round(r.slope, 9) for r in S.channel_slope(frame(spark, [0, 10, 20], z=[6, 3, 0])).collect()] == [0.3] * 3
    assert S.channel_slope(frame(spark, [0], z=[1])).first().slope is None
    assert all(r.slope is None or math.isfinite(r.slope) for r in S.channel_slope(frame(spark, [0, 5, 5, 10], z=[0, 5, 99, 10])).collect())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 20), st.one_of(st.none(), st.floats(-5, 5))), min_size=1, max_size=25), st.floats(0.5, 8))
def test_moving_average_equals_brute_force(spark, rows, window):
    s, y = zip(*rows, strict=True)
    got = {r.seq: r.m for r in S.moving_average(frame(spark, s, y=y), "y", window, "m").collect()}
    for i, x in enumerate(s):
        near = [b for a, b in rows if b is not None and x - window / 2 <= a <= x + window / 2]
        assert got[i] is None if not near else got[i] == pytest.approx(sum(near) / len(near), abs=1e-9)


def test_chi(spark):
    one = S.chi(frame(spark, [5, 4, 2, 0], A=[1, 1, 1, 1]), 0.5, 1.0, 1.0).orderBy("seq").collect()
    assert [r.chi for r in one] == [6, 5, 3, 1]
    back = S.chi(frame(spark, [0, 2, 4, 5], A=[9, 4, 4, 1]), 0.5).orderBy("seq").collect()
    forth = S.chi(frame(spark, [5, 4, 2, 0], A=[1, 4, 4, 9]), 0.5).orderBy("seq").collect()
    assert [r.chi for r in back] == [r.chi for r in forth][::-1]


def test_break_recovers_a_two_limb_cloud(spark):
    r = random.Random(0)
    rows = [(x := r.uniform(1.5, 5), -1 - 0.5 * max(0, x - 3) + r.gauss(0, 0.05)) for _ in range(600)]
    best = A.fit_break(spark.createDataFrame(rows, "logA double, logS double")).first()
    assert abs(best.logA_star - 3) < 0.1 and abs(best.theta - 0.5) < 0.05 and abs(best.hillslope_logS + 1) < 0.05
    assert A.fit_break(spark.createDataFrame(rows[:3], "logA double, logS double")).count() == 0


def test_transitions(spark):
    rows = [(5, i, float(x), 0.0, float(a)) for i, (x, a) in enumerate([(0, 1000), (10, 1100), (20, 2100)])] + [(6, 0, 0.0, 0.0, 1.0), (6, 1, 1.0, 0.0, 2.0), (7, 0, 0.0, 0.0, 5000.0), (7, 1, 1.0, 0.0, 6000.0)] + [(8, i, float(x), 0.0, float(a)) for i, (x, a) in enumerate([(20, 2100), (10, 1100), (0, 1000)])]
    got = {r.cat: r.x for r in A.transitions(spark.createDataFrame(rows, "cat long, seq int, x double, y double, A double"), 1200.0).collect()}
    assert got == {5: 11.0, 8: 11.0}
