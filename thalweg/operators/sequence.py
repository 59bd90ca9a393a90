"""Operators along ordered vertices: windows partitioned by segment, ordered by seq or distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite, hypot


def _w(by: str, order: str = "seq") -> Window:
    return Window.partitionBy(by).orderBy(order)


def drop_coincident(v: DataFrame, by: str = "cat") -> DataFrame:
    """Without vertices that lie on the one before, and segments with fewer than two left."""
    w = _w(by)
    same = (F.lag("x").over(w) == F.col("x")) & (F.lag("y").over(w) == F.col("y"))
    left = v.withColumn("_same", F.coalesce(same, F.lit(False))).filter("NOT _same").drop("_same")
    return left.withColumn("_n", F.count("*").over(Window.partitionBy(by))).filter("_n >= 2").drop("_n")


def segment_distances(v: DataFrame, by: str = "cat") -> DataFrame:
    """Adds s_down (from the first vertex) and s_up (to the last) along x, y."""
    w = _w(by)
    step = F.coalesce(hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    out = v.withColumn("_step", step).withColumn("s_down", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("s_up", F.max("s_down").over(Window.partitionBy(by)) - F.col("s_down")).drop("_step")


def moving_average(v: DataFrame, value: str, window: float, out: str, by: str = "cat", s: str = "s") -> DataFrame:
    """Mean of the non-null values within half a window of distance on either side, ends included."""
    clean = v.withColumn("_y", finite(F.col(value).cast("double")))
    half = repr(float(window) / 2)
    mean = F.expr(f"avg(_y) OVER (PARTITION BY `{by}` ORDER BY `{s}` RANGE BETWEEN {half}D PRECEDING AND {half}D FOLLOWING)")
    return clean.withColumn(out, mean).drop("_y")


def gradient(v: DataFrame, y: str, s: str, out: str, by: str = "cat", sign: float = 1.0) -> DataFrame:
    """dy/ds: second-order central differences for uneven steps, first-order at the ends; null where undefined."""
    w = _w(by)
    t = v.withColumn("_h1", F.col(s) - F.lag(s).over(w)).withColumn("_h2", F.lead(s).over(w) - F.col(s)).withColumn(
        "_y1", F.lag(y).over(w)).withColumn("_y2", F.lead(y).over(w))
    h1, h2, y0, y1, y2 = F.col("_h1"), F.col("_h2"), F.col(y), F.col("_y1"), F.col("_y2")
    zero = lambda x: F.nullif(x, F.lit(0.0))
    inner = (h1 * h1 * y2 + (h2 * h2 - h1 * h1) * y0 - h2 * h2 * y1) / zero(h1 * h2 * (h1 + h2))
    value = F.when(h1.isNull(), (y2 - y0) / zero(h2)).when(h2.isNull(), (y0 - y1) / zero(h1)).otherwise(inner)
    return t.withColumn(out, finite(F.lit(sign) * value)).drop("_h1", "_h2", "_y1", "_y2")


def channel_slope(v: DataFrame, z: str = "z", s: str = "s", out: str = "slope", by: str = "cat") -> DataFrame:
    """Slope, positive downstream."""
    return gradient(v, z, s, out, by, -1.0)


def chi(v: DataFrame, theta: float = 0.5, ref_area: float = 1.0, base: float = 0.0, area: str = "A", s: str = "s",
    out: str = "chi", by: str = "cat") -> DataFrame:
    """chi from the segment's mouth (its end with the larger area) up: each step adds (ref / A up)^theta * |ds|."""
    w = _w(by)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = v.withColumn("_flip", F.first(area).over(whole) > F.last(area).over(whole))
    term = lambda other: F.coalesce(F.pow(F.lit(ref_area) / F.col(area), F.lit(theta)) * F.abs(F.col(s) - other), F.lit(0.0))
    t = t.withColumn("_t", F.when(F.col("_flip"), term(F.lag(s).over(w))).otherwise(term(F.lead(s).over(w))))
    up = F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.sum("_t").over(w.rowsBetween(0, Window.unboundedFollowing))
    return t.withColumn(out, F.lit(base) + F.when(F.col("_flip"), up).otherwise(down)).drop("_flip", "_t")


def densify(v: DataFrame, dx: float, values: list[str], by: str = "cat", s: str = "s") -> DataFrame:
    """Evenly spaced stations (by, seq, s, values) at most dx apart, ends kept, values linear in between.

    Each interval of the given vertices makes the stations that fall into it, so there is no range join.
    Of coincident vertices the first counts; a segment of one station keeps its rows.
    """
    one = v.withColumn("_rn", F.row_number().over(Window.partitionBy(by, s).orderBy("seq"))).withColumn(
        "_all", F.count("*").over(Window.partitionBy(by)))
    all_ = Window.partitionBy(by)
    kept = one.filter("_rn = 1").withColumn("_lo", F.min(s).over(all_)).withColumn("_hi", F.max(s).over(all_))
    w = _w(by, s)
    n = F.greatest(F.ceil((F.col("_hi") - F.col("_lo")) / F.lit(dx)) + 1, F.lit(2))
    step = (F.col("_hi") - F.col("_lo")) / (n - 1)
    t = kept.withColumn("_n", n).withColumn("_step", step).withColumn("_next", F.lead(s).over(w))
    for x in values:
        t = t.withColumn(f"_n_{x}", F.lead(x).over(w))
    spans = t.filter("_next IS NOT NULL")
    first = F.ceil((F.col(s) - F.col("_lo")) / F.col("_step")).cast("long")
    last = F.when(F.col("_next") == F.col("_hi"), F.col("_n") - 1).otherwise(
        F.ceil((F.col("_next") - F.col("_lo")) / F.col("_step")) - 1).cast("long")
    spans = spans.withColumn("_a", first).withColumn("_b", last).filter("_a <= _b").withColumn("seq2", F.explode(F.sequence("_a", "_b")))
    at = F.when(F.col("seq2") == F.col("_n") - 1, F.col("_hi")).otherwise(F.col("_lo") + F.col("seq2") * F.col("_step"))
    f = (F.col("_at") - F.col(s)) / (F.col("_next") - F.col(s))
    even = spans.withColumn("_at", at).select(
        by, F.col("seq2").alias("seq"), F.col("_at").alias(s),
        *((F.col(x) + f * (F.col(f"_n_{x}") - F.col(x))).alias(x) for x in values))
    lone = kept.filter("_lo = _hi").select(by, F.lit(0).cast("long").alias("seq"), F.col(s), *values)
    return even.unionByName(lone)


def coarsen(v: DataFrame, fraction: float, values: list[str], by: str = "cat", s: str = "s") -> DataFrame:
    """max(1, round(fraction * n)) interior stations evenly along s, from the far end; half rounds to even."""
    all_ = Window.partitionBy(by)
    w = _w(by, s)
    t = v.withColumn("_cnt", F.count("*").over(all_)).filter("_cnt >= 3").withColumn(
        "_lo", F.min(s).over(all_)).withColumn("_hi", F.max(s).over(all_))
    t = t.withColumn("_m", F.greatest(F.lit(1.0), F.bround(F.lit(fraction) * F.col("_cnt"))).cast("long")).withColumn(
        "_step", (F.col("_hi") - F.col("_lo")) / (F.col("_m") + 1)).withColumn("_next", F.lead(s).over(w))
    for x in values:
        t = t.withColumn(f"_n_{x}", F.lead(x).over(w))
    a = F.greatest(F.lit(1), F.ceil((F.col(s) - F.col("_lo")) / F.col("_step"))).cast("long")
    b = F.least(F.col("_m"), F.ceil((F.col("_next") - F.col("_lo")) / F.col("_step")) - 1).cast("long")
    t = t.filter("_next > s").withColumn("_a", a).withColumn("_b", b).filter("_a <= _b").withColumn(
        "_k", F.explode(F.sequence("_a", "_b"))).withColumn("_at", F.col("_lo") + F.col("_k") * F.col("_step"))
    f = (F.col("_at") - F.col(s)) / (F.col("_next") - F.col(s))
    return t.select(by, (F.col("_m") - F.col("_k")).alias("seq"), F.col("_at").alias(s),
        *((F.col(x) + f * (F.col(f"_n_{x}") - F.col(x))).alias(x) for x in values))


def runs_above(v: DataFrame, flag: Column, least: int, by: str = "cat", order: str = "seq") -> DataFrame:
    """Maximal runs of consecutive vertices where flag holds, longer than `least`: (by, run_start, run_end, n)."""
    w = _w(by, order)
    t = v.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_i", F.row_number().over(w))
    t = t.filter("_f").withColumn("_g", F.col("_i") - F.row_number().over(w))
    return t.groupBy(by, "_g").agg(
        F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count("*").alias("n")).filter(
        F.col("n") > least).drop("_g")


def running_peak(v: DataFrame, y: str, drop: float = 0.8, samples: int = 5, by: str = "cat") -> DataFrame:
    """First vertex of each segment from which y stays under drop times the running maximum for so many samples: (by, peak, seq)."""
    w = _w(by)
    t = v.withColumn("_peak", F.max(y).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_low", F.col(y) < F.lit(drop) * F.col("_peak"))
    ahead = w.rowsBetween(0, samples - 1)
    t = t.withColumn("_all", F.every("_low").over(ahead) & (F.count("*").over(ahead) == samples))
    return t.filter("_all").groupBy(by).agg(
        F.min_by(F.struct(F.col("_peak").alias("peak"), "seq"), "seq").alias("v")).select(by, "v.peak", "v.seq")


def within(grid: DataFrame, flag: str, reach: int) -> DataFrame:
    """Adds w_left, w_right, w_up, w_down: is a flagged cell at most `reach` cells off that way (itself included)?"""
    out = grid
    for name, part, order, step in (("left", "r", "c", 1), ("right", "r", "c", -1), ("up", "c", "r", 1), ("down", "c", "r", -1)):
        w = Window.partitionBy(part).orderBy(F.col(order).asc() if step > 0 else F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
        near = F.last(F.when(F.col(flag), F.col(order)), ignorenulls=True).over(w)
        out = out.withColumn(f"w_{name}", F.coalesce(F.abs(F.col(order) - near) <= reach, F.lit(False)))
    return out


def set_outlet_elevations(nodes: DataFrame, inflow: DataFrame, drop: float = 4e-4) -> DataFrame:
    """Null z of nodes without outflow becomes the lowest last z that flows in, less a drop."""
    low = inflow.groupBy("node").agg(F.min("z").alias("_low"))
    return nodes.join(low, "node", "left").withColumn(
        "z", F.when(F.col("z").isNull() & (F.col("n_out") == 0), F.col("_low") - drop).otherwise(F.col("z"))).drop(
        "_low")


def windowed_slope(v: DataFrame, width: float, y: str = "z", x: str = "s", least: int = 3, by: str = "cat") -> DataFrame:
    """Adds slope: the steepness of the regression of y on x within width / 2 to either side, null for fewer than `least` points."""
    w = f"OVER (PARTITION BY {by} ORDER BY {x} RANGE BETWEEN {width / 2!r}D PRECEDING AND {width / 2!r}D FOLLOWING)"
    return v.selectExpr("*", f"abs(CASE WHEN count(*) {w} >= {least} THEN regr_slope({y}, {x}) {w} END) AS slope")


def chi_steepness(v: DataFrame, by: str = "cat") -> DataFrame:
    """Adds ksn (dz by dchi) and ksn_change (its own gradient along chi)."""
    return gradient(gradient(v, "z", "chi", "ksn", by), "ksn", "chi", "ksn_change", by)


def rollovers(v: DataFrame, by: str = "cat") -> DataFrame:
    """(by, seq, chi, ksn_change): the vertex of each profile where steepness changes most, the first of equal ones."""
    t = chi_steepness(v, by).filter("ksn_change IS NOT NULL")
    return t.groupBy(by).agg(
        F.max(F.struct(F.abs("ksn_change").alias("k"), (-F.col("seq")).alias("s"), "seq", "chi", "ksn_change")).alias(
            "b")).select(by, "b.seq", "b.chi", "b.ksn_change")
