"""Metrics of divides, hillslopes and profiles: relief and asymmetry, recession priors by zone, steepness with breaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import keep, prefix_sums
from .divides import decode_corner

# ---- divides


def divide_metrics(edges: DataFrame, hillslopes: DataFrame, ncols: int) -> DataFrame:
    """(a, b, n1, n2, hr1, hr2, hr, fd, dai) of divide edges (corners a, b) from each cell's way to its channel.

    hillslopes: (node, height, dist), the drop and flow distance to the channel, as `nearest_drainage` gives them. hr is
    the hillslope relief and fd the flow distance, means of the two sides; dai the asymmetry, 0 for equal reliefs
    and 1 where one side has none (null where neither has). Edges with a side that meets no channel: null metrics.
    """
    # an edge to the next row of corners has its cells left and right of it, one along a row above and below
    t = decode_corner(edges, "a", ncols)
    upright = F.col("b") - F.col("a") == ncols + 1
    node = lambda r, c: (r * ncols + c).cast("long")
    t = t.select(
        "a", "b", F.when(upright, node(F.col("i"), F.col("j") - 1)).otherwise(node(F.col("i") - 1, F.col("j"))).alias("n1"),
        node(F.col("i"), F.col("j")).alias("n2"))
    for k in "12":
        side = hillslopes.select(F.col("node").alias(f"n{k}"), F.col("height").alias(f"hr{k}"), F.col("dist").alias(f"fd{k}"))
        t = t.join(side, f"n{k}", "left")
    total = F.col("hr1") + F.col("hr2")
    return t.select(
        "a", "b", "n1", "n2", "hr1", "hr2", (total / 2).alias("hr"), ((F.col("fd1") + F.col("fd2")) / 2).alias("fd"),
        (F.abs(F.col("hr1") - F.col("hr2")) / F.nullif(total, F.lit(0.0))).alias("dai"))


def metrics_by(metrics: DataFrame, of: DataFrame, by: str) -> DataFrame:
    """(by, n, hr, fd, dai): means over the edges of each segment or order; of: (a, b, by), corners of an edge in either order.

    n counts edges that have a relief.
    """
    ends = lambda t: [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    t = metrics.select(*ends(metrics), "hr", "fd", "dai").join(of.select(*ends(of), by), ["a", "b"])
    return t.groupBy(by).agg(F.count("hr").alias("n"), *(F.avg(c).alias(c) for c in ("hr", "fd", "dai")))


# ---- zones


def zonal_quantiles(rows: DataFrame, zone: str, value: str, shares: list[float], key: str) -> DataFrame:
    """(zone, n, share, q): exact quantiles of value in each zone, linear between ranks, whatever a zone's size.

    All rows are sorted once by zone and value, in ranges; a rank in a zone is a place in this order, and only the rows
    at the wanted places are looked up. key tells equal rows apart. Null and NaN values are left out.
    """
    t = rows.select(F.col(zone).alias("zone"), F.col(value).cast("double").alias("x"), F.col(key).alias("k")).filter(
        F.col("zone").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x"))
    placed = keep(prefix_sums(t, ["zone", "x", "k"], F.lit(1).cast("long"), "place").select("zone", "x", "place"), "placed")
    zones = placed.groupBy("zone").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    wanted = zones.select("zone", "n", F.explode(F.array(*map(F.lit, shares))).alias("share"), "first").withColumn("at", F.col("share") * (F.col("n") - 1))
    low = (F.col("first") + F.floor("at")).cast("long")
    w = wanted.withColumn("low", low).withColumn("high", (F.col("first") + F.ceil("at")).cast("long"))
    for c in ("low", "high"):
        w = w.join(placed.select(F.col("place").alias(c), F.col("x").alias(f"x_{c}")), c)
    q = F.when(F.col("x_low") == F.col("x_high"), F.col("x_low")).otherwise(F.col("x_low") + (F.col("at") - F.floor("at")) * (F.col("x_high") - F.col("x_low")))
    return w.select(F.col("zone").alias(zone), "n", "share", q.alias("q"))


def recession_times(hillslopes: DataFrame, conductivity="1e-4", porosity="0.2", thickness="1.0") -> DataFrame:
    """hillslopes (node, height, dist, ...) with slope (an angle), tau_adv, tau_diff and peclet, their ratio.

    tau_adv = L f / (K sin slope), tau_diff = L^2 f / (K H). K, f and H are SQL expressions: numbers or columns. Cells on the
    channel (dist 0), level ones and those without a channel have null times.
    """
    drop, way = F.col("height"), F.nullif("dist", F.lit(0.0))
    k, f, h = (F.expr(str(x)).cast("double") for x in (conductivity, porosity, thickness))
    t = hillslopes.withColumn("slope", F.atan(drop / way))
    t = t.withColumn("tau_adv", F.when(drop > 0, way * f / (k * F.sin("slope")))).withColumn("tau_diff", F.when(drop > 0, way * way * f / (k * h)))
    return t.withColumn("peclet", F.col("tau_diff") / F.col("tau_adv"))


def recession_priors(times: DataFrame, zone: str, shares: list[float] = [0.05, 0.5, 0.95], key: str = "node") -> DataFrame:  # noqa: B006
    """(zone, share, n, and dist, slope, tau_adv, tau_diff, peclet at that share) over a zone's cells that have times."""
    t = keep(times.filter("tau_adv IS NOT NULL").select(zone, key, "dist", "slope", "tau_adv", "tau_diff", "peclet"), "times")
    out = None
    for c in ("dist", "slope", "tau_adv", "tau_diff", "peclet"):
        got = zonal_quantiles(t, zone, c, shares, key).withColumnRenamed("q", c)
        out = got if out is None else out.join(got.drop("n"), [zone, "share"])
    return out


def width_function(hillslopes: DataFrame, zone: str, width: float, distance: str = "dist") -> DataFrame:
    """(zone, bin, n): cells of each zone by their flow distance in steps of width, the distribution of travel distances.

    Distances within a billionth of a step's end count as at it.
    """
    t = hillslopes.filter(F.col(distance).isNotNull() & F.col(zone).isNotNull())
    return t.groupBy(zone, F.floor(F.round(F.col(distance) / width, 9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


# ---- profiles


def segmented(x: np.ndarray, y: np.ndarray, penalty: float, least: int = 3) -> list[tuple[int, int, float, float, float]]:
    """Least-squares lines over runs of at least `least` points: (first, last, slope, intercept, residual) of each run.

    The runs minimise the residuals' sum plus a penalty for each run, exactly: the best way to end at a point is found for
    all its last runs at once, from running sums. A run that loses by more than the penalty to others never comes back
    and is not tried again. Of equally good ways the longest last run counts. Fewer points than `least`: no run.
    """
    n = len(x)
    if n < least:
        return []
    u, v = x - x.mean(), y - y.mean()
    sums = np.concatenate([np.zeros((5, 1)), np.cumsum([u, v, u * u, u * v, v * v], axis=1)], axis=1)

    def lines(i: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Residual and slope of the runs from each i up to, not including, j."""
        su, sv, suu, suv, svv = sums[:, j, None] - sums[:, i]
        m = j - i
        uu, uv, vv = suu - su * su / m, suv - su * sv / m, svv - sv * sv / m
        level = uu <= 1e-12 * np.maximum(suu, 1e-300)
        slope = np.where(level, 0.0, uv / np.where(level, 1.0, uu))
        return np.maximum(0.0, vv - slope * uv), slope

    best, from_ = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    best[0] = 0.0
    slack = 1e-9 * float(v @ v)
    tried, until = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for j in range(least, n + 1):
        if np.isfinite(best[j - least]):
            tried, until = np.append(tried, j - least), np.append(until, n + 1)
        tried, until = tried[until > j], until[until > j]
        cost = best[tried] + lines(tried, j)[0]
        k = int(np.argmin(cost))
        best[j], from_[j] = cost[k] + penalty, tried[k]
        # a run that costs more than all there is up to here loses to a cut here, once what follows is long enough
        until = np.where(cost > best[j] + slack, np.minimum(until, j + least), until)
    out, j = [], n
    while j > 0:
        i = int(from_[j])
        rss, slope = (float(t[0]) for t in lines(np.array([i]), j))
        out.append((i, j - 1, slope, float(y[i:j].mean() - slope * x[i:j].mean()), rss))
        j = i
    return out[::-1]


def steepness(v: DataFrame, penalty: float, least: int = 3, ref_area: float = 1.0, theta: float = 0.5, by: str = "cat") -> DataFrame:
    """(by, piece, first, last, chi_from, chi_to, ksn, z0, rss): profiles (by, seq, chi, z) cut where their steepness changes.

    A piece is a line of z over chi, its slope times ref_area ^ theta the steepness index. Pieces come from the mouth
    up; first and last are their least and greatest seq. penalty: what another piece must at least take off the squared
    residuals. A profile's points go to one task; null chi or z are left out.
    """

    def one(key, pdf):
        pdf = pdf.sort_values(["chi", "seq"], ignore_index=True)
        x = pdf.chi.to_numpy(float)
        got = segmented(x, pdf.z.to_numpy(float), penalty, least)
        seq = pdf.seq.to_numpy()
        return pd.DataFrame([(key[0], k, int(seq[i:j + 1].min()), int(seq[i:j + 1].max()), x[i], x[j], slope * ref_area**theta, z0, rss)
            for k, (i, j, slope, z0, rss) in enumerate(got)], columns=[by, "piece", "first", "last", "chi_from", "chi_to", "ksn", "z0", "rss"])

    kind = v.schema[by].dataType.simpleString()
    return v.select(by, "seq", "chi", "z").dropna().groupBy(by).applyInPandas(
        one, f"{by} {kind}, piece int, first int, last int, chi_from double, chi_to double, ksn double, z0 double, rss double")
