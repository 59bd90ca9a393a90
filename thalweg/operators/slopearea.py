"""Slope-area analytics: clouds, broken-stick breaks, transitions, binned medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import keep
from .quantiles import exact_quantiles, group_medians
from .sequence import channel_slope, moving_average

KNOTS = 200


def cloud(v: DataFrame, window: float | None = None, log: bool = True, min_slope: float | None = None,
    max_area: float | None = None) -> DataFrame:
    """(cat, seq, logA, logS) of vertices with positive area and slope (A, slope if not log)."""
    area = "A"
    if window:
        v = moving_average(v, "z", window, "z_smooth")
        v = moving_average(v, "A", window, "A_smooth")
        area = "A_smooth"
    t = channel_slope(v, "z_smooth" if window else "z").select("cat", "seq", F.col(area).alias("A"), "slope")
    if not log:
        return t
    t = t.filter("A > 0 AND slope > 0").select("cat", "seq", F.log10("A").alias("logA"), F.log10("slope").alias("logS"))
    if min_slope is not None:
        t = t.filter(F.col("logS") >= F.log10(F.lit(min_slope)))
    return t if max_area is None else t.filter(F.col("logA") <= F.log10(F.lit(max_area)))


def break_scan(points: DataFrame, min_side: int = 10, knots: int = KNOTS) -> DataFrame:
    """Residuals of the flat-then-power-law fit at each candidate knot: (k, knot, n_left, n_right, h, slope, rss).

    Points are summed by the knots they lie between (one partial aggregate, `knots` + 1 rows) and the sums
    accumulated over those few rows, so the cost does not grow with points times knots.
    """
    points = keep(points.select("logA", "logS"), "cloud")
    lo, hi = exact_quantiles(points, "logA", [0.05, 0.95]).get(None, (None, None))
    ends = points.agg(
        F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"), F.avg("logA").alias("mx"),
        F.avg("logS").alias("my"), F.count("*").alias("n"))
    t = points.crossJoin(F.broadcast(ends))  # one row
    step = (F.col("hi") - F.col("lo")) / (knots - 1)
    # number of knots below logA: the point is right of those
    below = F.greatest(F.lit(0), F.least(F.lit(knots), F.ceil((F.col("logA") - F.col("lo")) / F.nullif(step, F.lit(0.0))))).cast("int")
    below = F.when(step > 0, below).otherwise(F.when(F.col("logA") > F.col("lo"), knots).otherwise(0))
    x, y = F.col("logA") - F.col("mx"), F.col("logS") - F.col("my")
    sums = t.groupBy(below.alias("b")).agg(
        F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"),
        F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"))
    ks = points.sparkSession.range(knots).select(F.col("id").cast("int").alias("k"))
    right = ks.join(F.broadcast(sums), F.col("b") > F.col("k"), "left").groupBy("k").agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "x", "y", "xx", "xy")))
    whole = sums.agg(F.sum("yy").alias("syy"))
    u = right.withColumnRenamed("n", "n_right").crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(whole))
    knot = F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / (knots - 1)
    u = u.withColumn("knot", knot).withColumn("q", F.col("knot") - F.col("mx"))
    n = F.col("n").cast("double")
    u = u.withColumn("su", F.col("x") - F.col("q") * F.col("n_right")).withColumn(
        "suu", F.col("xx") - 2 * F.col("q") * F.col("x") + F.col("q") * F.col("q") * F.col("n_right") - F.col(
            "su") * F.col("su") / n).withColumn("suy", F.col("xy") - F.col("q") * F.col("y"))
    slope = F.col("suy") / F.nullif(F.col("suu"), F.lit(0.0))
    u = u.withColumn("slope", slope).withColumn("h", F.col("my") - F.col("slope") * F.col("su") / n).withColumn(
        "rss", F.col("syy") - F.col("slope") * F.col("suy")).withColumn("n_left", F.col("n") - F.col("n_right"))
    return u.filter((F.col("n_left") >= min_side) & (F.col("n_right") >= min_side) & F.col(
            "rss").isNotNull() & (F.col("n") >= 2 * min_side)).select(
        "k", "knot", "n_left", "n_right", "h", "slope", "rss")


def fit_break(points: DataFrame, min_side: int = 10) -> DataFrame:
    """The knot of least residual (the first of equal ones): one row, or none with too few points."""
    best = break_scan(points, min_side).agg(
        F.min(F.struct("rss", "k", "knot", "h", "slope", (F.col("n_left") + F.col("n_right")).alias("n"))).alias(
            "b")).filter("b IS NOT NULL")
    return best.select(
        F.col("b.k").alias("k"), F.col("b.knot").alias("logA_star"), F.pow(F.lit(10.0), "b.knot").alias("A_star"),
        (-F.col("b.slope")).alias("theta"), F.col("b.h").alias("hillslope_logS"), F.col("b.rss").alias("rss"),
        F.col("b.n").alias("n"))


def transitions(v: DataFrame, a_star: float) -> DataFrame:
    """(cat, x, y): where each segment's area first reaches a_star going downstream, linear between vertices."""
    w = Window.partitionBy("cat").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = v.withColumn("_flip", F.first("A").over(whole) > F.last("A").over(whole)).withColumn(
        "_i", F.when(F.col("_flip"), -F.col("seq")).otherwise(F.col("seq")))
    w = Window.partitionBy("cat").orderBy("_i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("_a0", F.first("A").over(whole)).withColumn("_a1", F.last("A").over(whole)).withColumn("_n", F.count("*").over(whole))
    for c in ("A", "x", "y"):
        t = t.withColumn(f"_p{c}", F.lag(c).over(w))
    hit = t.filter((F.col("_n") >= 2) & (F.col("_a0") < a_star) & (F.col("_a1") >= a_star) & (F.col("A") >= a_star))
    f = (F.lit(a_star) - F.col("_pA")) / (F.col("A") - F.col("_pA"))
    at = lambda c: F.col(f"_p{c}") + f * (F.col(c) - F.col(f"_p{c}"))
    return hit.groupBy("cat").agg(F.min_by(F.struct(at("x").alias("x"), at("y").alias("y")), "_i").alias("p")).select("cat", "p.x", "p.y")


def binned_medians(points: DataFrame, bins: int = 18, least: int = 8, x: str = "logA", y: str = "logS", closed: bool = False) -> DataFrame:
    """(bin, n, x, y): medians in equal-width bins with enough points; the largest x is outside the last bin unless it is closed."""
    points = keep(points.select(x, y), "points")
    e = points.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    t = points.crossJoin(F.broadcast(e))
    bin_ = F.floor((F.col(x) - F.col("_lo")) / F.nullif((F.col("_hi") - F.col("_lo")) / bins, F.lit(0.0))).cast("int")
    if closed:
        bin_ = F.least(bin_, F.lit(bins - 1))
    t = t.withColumn("bin", bin_).filter((F.col("bin") >= 0) & (F.col("bin") < bins) & (F.lit(closed) | (F.col(x) < F.col("_hi"))))
    return group_medians(t.select("bin", F.col(x).alias("x"), F.col(y).alias("y")), "bin", ["x", "y"]).filter(F.col("n") >= least)


#: Fixed values of the gate on sticks: least fit, least distance of the break from an end (of the range), range of theta; knots tried.
LEAST_R, LEAST_EDGE, THETAS, STICK_KNOTS = 0.3, 0.1, (0.2, 1.5), 50
#: Fixed values of the tent: least rise, greatest (negative) fall, least fit.
TENT_RISE, TENT_FALL, TENT_FIT = 0.05, -0.10, 0.5


def _line_rss(x, y) -> float:
    x0, y0 = x - x.mean(), y - y.mean()
    return float(y0 @ y0 - (x0 @ y0) ** 2 / (x0 @ x0))


def stick(x, y) -> tuple | None:
    """(knot, theta, h, R, edge, accepted) of a level-then-falling stick through medians (x rising), or None for fewer than six.

    R is the share of a straight line's residual that the break takes away, edge the distance of the knot
    from the nearer end as a share of the range.
    """
    import numpy as np

    if len(x) < 6:
        return None
    knots = np.linspace(x[1], x[-2], STICK_KNOTS)
    left = (x <= knots[:, None]).sum(axis=1)
    knots = knots[(left >= 2) & (len(x) - left >= 2)]
    u = np.maximum(0.0, x - knots[:, None])
    mid = u.mean(axis=1)
    u0, y0 = u - mid[:, None], y - y.mean()
    slope = u0 @ y0 / (u0 * u0).sum(axis=1)
    rss = ((y0 - slope[:, None] * u0) ** 2).sum(axis=1)
    k = int(rss.argmin())
    line = _line_rss(x, y)
    fit = 1 - rss[k] / line if line > 0 else 0.0
    edge = min(knots[k] - x[0], x[-1] - knots[k]) / (x[-1] - x[0])
    ok = fit >= LEAST_R and edge >= LEAST_EDGE and THETAS[0] <= -slope[k] <= THETAS[1]
    return float(knots[k]), float(-slope[k]), float(y.mean() - slope[k] * mid[k]), float(fit), float(edge), bool(ok)


def _lines(x, y):
    """(slope, intercept, residual) of the least-squares line through the first k + 1 points, for every k from 1.

    All of them from running sums of the points around the first; entry 0 has no line (NaN).
    """
    import numpy as np

    u, v = x - x[0], y - y[0]
    n = np.arange(1.0, len(x) + 1)
    su, sv, suu, suv, svv = (np.cumsum(t) for t in (u, v, u * u, u * v, v * v))
    with np.errstate(divide="ignore", invalid="ignore"):
        uu, uv, vv = suu - su * su / n, suv - su * sv / n, svv - sv * sv / n
        slope = uv / uu
        return slope, (sv - slope * su) / n + y[0] - slope * x[0], np.maximum(0.0, vv - slope * uv)


def peak(x, y) -> tuple | None:
    """(peak, R, theta) of two lines through medians (x rising) that share a median, rising then falling; None if none does so well enough.

    A line's residual over any start or end of the medians comes from running sums, so all peaks are weighed at once.
    The shared median counts with the rising line.
    """
    import numpy as np

    n = len(x)
    if n < 7:
        return None
    up, _, before = _lines(x, y)
    down, base, after = (t[::-1] for t in _lines(x[::-1], y[::-1]))
    miss = before + after - (y - down * x - base) ** 2
    at = np.arange(n)
    miss[(at < 2) | (at > n - 3) | ~(up > TENT_RISE) | ~(down < TENT_FALL)] = np.inf
    top, line = int(miss.argmin()), _line_rss(x, y)
    fit = 1 - miss[top] / line if line > 0 else 0.0
    return (float(x[top]), float(fit), float(-down[top])) if np.isfinite(miss[top]) and fit >= TENT_FIT else None


def _of_medians(points: DataFrame, bins: int, least: int, fit, schema: str, closed: bool = False) -> DataFrame:
    import numpy as np

    m = sorted((r.x, r.y) for r in binned_medians(points, bins, least, closed=closed).collect())  # a row a bin
    got = fit(*np.array(m).T) if m else None
    return points.sparkSession.createDataFrame([] if got is None else [got], schema)


def binned_break(points: DataFrame, bins: int = 18, least: int = 8) -> DataFrame:
    """One row (logA_star, theta, hillslope_logS, R, edge, accepted) from `stick` over binned medians, or none."""
    return _of_medians(
        points, bins, least, stick,
        "logA_star double, theta double, hillslope_logS double, R double, edge double, accepted boolean")


def tent(points: DataFrame, bins: int = 12, least: int = 2) -> DataFrame:
    """One row (peak, R, theta) from `peak` over binned medians (the last bin closed), or none."""
    return _of_medians(points, bins, least, peak, "peak double, R double, theta double", closed=True)


def accepted_stick(x, y) -> tuple[float, float] | None:
    """(logA_star, theta) of the stick through medians, if it is accepted."""
    got = stick(x, y)
    return got[:2] if got and got[-1] else None


def stick_gate(x, y, bins: int = 18, least: int = 8) -> tuple[float, float] | None:
    """(logA_star, theta) of a cloud in memory whose stick is accepted; bins as in `binned_medians`."""
    import pandas as pd

    width = (x.max() - x.min()) / bins if len(x) >= 2 * least else 0.0
    if not width > 0:
        return None
    t = pd.DataFrame({"x": x, "y": y, "bin": ((x - x.min()) / width).astype(int)})[x < x.max()]
    by = t.groupby("bin").filter(lambda g: len(g) >= least).groupby("bin")[["x", "y"]].median()
    return accepted_stick(by["x"].to_numpy(), by["y"].to_numpy())


def area_survival(v: DataFrame, levels: int = 60) -> DataFrame:
    """(k, a, p): share of cells with area at least a, on log-spaced levels; by counts per level, not a cross join."""
    e = v.filter("A > 0").agg(F.log10(F.min("A")).alias("lo"), F.log10(F.max("A")).alias("hi"), F.count("*").alias("n"))
    t = v.filter("A > 0").crossJoin(F.broadcast(e))
    step = (F.col("hi") - F.col("lo")) / (levels - 1)
    k = F.least(F.lit(levels - 1), F.floor((F.log10("A") - F.col("lo")) / F.nullif(step, F.lit(0.0)) + 1e-9)).cast("int")
    counts = t.groupBy(F.coalesce(k, F.lit(0)).alias("k0")).agg(F.count("*").alias("m"))
    ks = v.sparkSession.range(levels).select(F.col("id").cast("int").alias("k"))
    return ks.join(F.broadcast(counts), F.col("k0") >= F.col("k"), "left").groupBy("k").agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("m")).crossJoin(F.broadcast(e)).select(
        "k", F.pow(F.lit(10.0), F.col("lo") + F.col("k") * step).alias("a"), (F.col("m") / F.col("n")).alias("p"))


def snap_dedup(points: DataFrame, snap: float) -> DataFrame:
    """The point of the best R in each square of a snapping grid (the smallest id of equal ones)."""
    key = [F.round(F.col(c) / snap).cast("long") for c in ("x", "y")]
    best = points.groupBy(key[0].alias("gx"), key[1].alias("gy")).agg(F.max(F.struct("R", (-F.col("id")).alias("i"), "x", "y")).alias("b"))
    return best.select("gx", "gy", (-F.col("b.i")).alias("id"), F.col("b.R").alias("R"), F.col("b.x").alias("x"), F.col("b.y").alias("y"))
