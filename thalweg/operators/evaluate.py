"""Validation analytics: matching points, ranking quality, relief statistics, edge-set overlap."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import keep, prefix_sums, together
from .quantiles import exact_quantiles
from .tiles import stencil, windows


def near_pairs(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """(id_a, id_b, d): pairs of points within reach, met in squares of that size: an equi-join on nine squares."""
    square = lambda c: F.floor(F.col(c) / reach)
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    left = a.select(F.col("id").alias("id_a"), F.col("x").alias("xa"), F.col("y").alias("ya"),
        F.explode(around).alias("o")).withColumn("gx", square("xa") + F.col("o.i")).withColumn(
        "gy", square("ya") + F.col("o.j"))
    right = b.select(F.col("id").alias("id_b"), F.col("x").alias("xb"), F.col("y").alias("yb"), square("x").alias("gx"), square("y").alias("gy"))
    d = F.sqrt((F.col("xa") - F.col("xb")) ** 2 + (F.col("ya") - F.col("yb")) ** 2)
    return left.join(right, ["gx", "gy"]).withColumn("d", d).filter(F.col("d") <= reach).select("id_a", "id_b", "d")


#: Places of b that a place of a may meet on the average before smaller squares are tried first.
CROWD = 512
#: What lies within this part of a square's width is surely met from the squares beside it, rounding or not.
SURE = 0.999


def nearest_by_spots(a: DataFrame, b: DataFrame, scales: dict[str, float], meet, d: str) -> DataFrame:
    """(id_a, id_b, d): what meet finds for each distinct place of a among the distinct places of b, the smallest id at each.

    meet(a, b, share) gives each a's nearest b within that share of the reach, met in squares of that share of the
    scales. Where places are crowded small shares come first: what has found its match there doesn't meet what lies farther
    off. Rows at one place don't multiply, however many they are.
    """
    names = list(scales)
    spots = keep(b.groupBy(*names).agg(F.min("id").alias("id")), "spots")
    left = keep(a.select(*names).distinct(), "left")
    share, found = 1.0, []
    while share > 2.0**-30:
        per = spots.groupBy(*(F.floor(F.col(n) / (s * share)).alias(n) for n, s in scales.items())).agg(F.count("*").cast("double").alias("k"))
        if (per.agg(F.sum(F.col("k") * F.col("k")) / F.sum("k")).first()[0] or 0) * 3 ** len(names) <= CROWD:
            break
        share /= 2
    while True:
        found.append(keep(meet(left.withColumn("id", F.struct(*names)), spots, share), "nearest"))
        if share == 1:
            break
        left = keep(left.join(found[-1].select("id_a.*").hint("merge"), names, "left_anti"), "left")
        share *= 2
    got = together(found).select("id_a.*", "id_b", d).hint("merge")
    return a.select("id", *names).join(got, names).groupBy(F.col("id").alias("id_a")).agg(F.min(F.struct(d, "id_b")).alias("m")).select(
        "id_a", "m.id_b", f"m.{d}")


def nearest(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """(id_a, id_b, d): each point's nearest within reach, the smaller id of equal ones."""
    def meet(x, y, share):
        pairs = near_pairs(x, y, reach * share)
        pairs = pairs if share == 1 else pairs.filter(F.col("d") <= SURE * reach * share)
        return pairs.groupBy("id_a").agg(F.min(F.struct("d", "id_b")).alias("m")).select("id_a", "m.id_b", "m.d")

    return nearest_by_spots(a, b, {"x": reach, "y": reach}, meet, "d")


def nearest_of_all(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """(id_a, id_b, d): each point's nearest, however far: points without one in reach are tried with twice the reach.

    The squares grow only for the points that are left, which lie where there is little to meet.
    """
    done, left = [], keep(a.select("id", "x", "y"), "left")
    if not b.limit(1).count():
        return nearest(left.limit(0), b, reach)
    while left.limit(1).count():
        found = keep(nearest(left, b, reach), "nearest")
        done.append(found)
        left = keep(left.join(found.select(F.col("id_a").alias("id")), "id", "left_anti"), "left")
        reach *= 2
    return reduce(DataFrame.unionByName, done) if done else nearest(left, b, reach)


def snap_to_channel(a: DataFrame, channel: DataFrame, reach: float, least: float | None = None,
    most: float | None = None, area: str = "ncontrib") -> DataFrame:
    """(id_a, id_b, d): each point's nearest channel cell (id, x, y, area) whose area lies in the window."""
    b = channel if least is None else channel.filter(F.col(area) >= least)
    return nearest(a, b if most is None else b.filter(F.col(area) <= most), reach)


def match_quality(found: DataFrame, known: DataFrame, tolerance: float) -> DataFrame:
    """One row: recall (known points with a found one in tolerance), precision (the reverse), counts, median distance."""
    met = keep(nearest(known, found, tolerance), "met")
    (middle,) = exact_quantiles(met, "d", [0.5]).get(None, [None])
    hit = met.agg(F.count("*").alias("hits"), F.lit(middle).cast("double").alias("median_d"))
    right = nearest(found, known, tolerance).agg(F.count("*").alias("right"))
    n, m = known.agg(F.count("*").alias("n_known")), found.agg(F.count("*").alias("n_found"))
    t = hit.crossJoin(right).crossJoin(n).crossJoin(m)  # four single rows
    return t.select("n_known", "n_found", (F.col("hits") / F.nullif("n_known", F.lit(0))).alias("recall"),
        (F.col("right") / F.nullif("n_found", F.lit(0))).alias("precision"), "median_d")


def snap_to_max(points: DataFrame, cells: DataFrame, reach: int, value: str) -> DataFrame:
    """(id, r, c, value): the cell of largest value within reach rows and columns of each point's cell."""
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    p = points.select("id", F.explode(around).alias("o"), "r", "c").select(
        "id", (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"))
    return p.join(cells.select("r", "c", F.col(value).alias("v")), ["r", "c"]).groupBy("id").agg(
        F.max(F.struct("v", (-F.col("r")).alias("a"), (-F.col("c")).alias("b"))).alias("m")).select(
        "id", (-F.col("m.a")).alias("r"), (-F.col("m.b")).alias("c"), F.col("m.v").alias(value))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: P(positive above negative) + half P(equal), by counts per distinct score and running sums over them."""
    per = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    per = prefix_sums(per, ["s"], F.col("n"), "upto").select(
        F.col("p").cast("double").alias("p"), F.col("n").cast("double").alias("n"),
        (F.col("upto") - F.col("n")).cast("double").alias("b"))
    return per.agg((F.sum(F.col("p") * (F.col("b") + F.col("n") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0.0))).alias("auc"))


def structure_function(cells: DataFrame, lags: list[int]) -> DataFrame:
    """(lag, gamma, n): mean squared difference of z at each lag along rows and columns."""
    steps = F.explode(
        F.array(*(F.struct(F.lit(k).alias("lag"), F.lit(k * i).alias("dr"),
                    F.lit(k * (1 - i)).alias("dc")) for k in lags for i in (0, 1))))
    a = cells.select("r", "c", "z", steps.alias("o")).select(
        (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), F.col("o.lag").alias("lag"),
        F.col("z").alias("z0"))
    d = F.col("z") - F.col("z0")
    return a.join(cells.select("r", "c", "z"), ["r", "c"]).groupBy("lag").agg(F.avg(d * d).alias("gamma"), F.count("*").alias("n"))


def hurst(gamma: DataFrame) -> DataFrame:
    """One row: half the slope of ln gamma on ln lag."""
    return gamma.filter("gamma > 0").agg(
        (F.regr_slope(F.log("gamma"), F.log("lag")) / 2).alias("hurst"),
        F.corr(F.log("lag"), F.log("gamma")).alias("r"))


def edge_overlap(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row: recall, precision and Jaccard of undirected edges (a, b)."""
    flat = lambda e, n: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn(n, F.lit(1))
    t = flat(ours, "o").join(flat(theirs, "t"), ["a", "b"], "full").agg(
        F.count("o").alias("o"), F.count("t").alias("t"),
        F.count_if(F.col("o").isNotNull() & F.col("t").isNotNull()).alias("both"))
    rate = lambda x: F.col("both") / F.nullif(x, F.lit(0))
    return t.select(rate(F.col("t")).alias("recall"), rate(F.col("o")).alias("precision"),
        rate(F.col("o") + F.col("t") - F.col("both")).alias("jaccard"), "both")


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def side(ps):
        out: list = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return side(p) + side(p[::-1])


#: Partial hulls that one task merges.
HULLS = 64


def hull_corners(points: DataFrame) -> DataFrame:
    """One row (corners: array of (x, y), anticlockwise) of the points' convex hull: a hull a partition, merged as a tree."""
    import pandas as pd

    def partial(frames):
        from pyspark import TaskContext

        own: list = []
        for pdf in frames:
            own = hull([*own, *zip(pdf.x.tolist(), pdf.y.tolist())])
        yield pd.DataFrame(own, columns=["x", "y"], dtype=float).assign(part=TaskContext.get().partitionId())

    def merged(pdf):
        return pd.DataFrame(hull(list(zip(pdf.x, pdf.y))), columns=["x", "y"], dtype=float).assign(part=pdf.part.iloc[0])

    def whole(pdf):
        return pd.DataFrame({"corners": [[{"x": x, "y": y} for x, y in hull(list(zip(pdf.x, pdf.y)))]]})

    rows = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    parts, kind = rows.rdd.getNumPartitions(), "x double, y double, part long"
    t = rows.mapInPandas(partial, kind)
    while parts > HULLS:
        t = t.withColumn("part", F.expr(f"part div {HULLS}")).groupBy("part").applyInPandas(merged, kind)
        parts = -(-parts // HULLS)
    return t.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(whole, "corners array<struct<x: double, y: double>>")


def within_hull(points: DataFrame, corners: DataFrame | list[tuple[float, float]], buffer: float = 0.0) -> DataFrame:
    """Points inside a hull whose corners are moved outwards from their centre by a buffer.

    corners: points (x, y) to lay the hull around, in a table of any size, or a list of corners as `hull` gives them.
    Each point is held against the edges of the one row that the hull is.
    """
    if isinstance(corners, list):
        at = points.sparkSession.createDataFrame([([(float(x), float(y)) for x, y in corners],)], "corners array<struct<x: double, y: double>>")
    else:
        at = hull_corners(corners)
    n = F.size("corners")
    mean = lambda k: F.aggregate("corners", F.lit(0.0), lambda acc, p: acc + p[k]) / n
    at = at.select("corners", mean("x").alias("cx"), mean("y").alias("cy"))

    def moved(p):
        d = F.sqrt((p["x"] - F.col("cx")) ** 2 + (p["y"] - F.col("cy")) ** 2)
        by = F.lit(float(buffer)) / F.nullif(d, F.lit(0.0))
        return F.struct((p["x"] + F.coalesce(by, F.lit(0.0)) * (p["x"] - F.col("cx"))).alias("x"), (p["y"] + F.coalesce(by, F.lit(0.0)) * (p["y"] - F.col("cy"))).alias("y"))

    ring = at.select(F.transform("corners", moved).alias("corners"))
    pairs = F.arrays_zip(F.col("corners").alias("p"), F.concat(F.slice("corners", 2, n), F.slice("corners", 1, 1)).alias("q"))
    edges = ring.select(F.when(n > 2, pairs).alias("_edges"))
    left = lambda e: (e["q"]["x"] - e["p"]["x"]) * (F.col("y") - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (F.col("x") - e["p"]["x"]) >= 0
    return points.crossJoin(F.broadcast(edges)).filter(F.forall("_edges", left)).drop("_edges")  # one row


def distinct_near(cells: DataFrame, label: str, reach: int) -> DataFrame:
    """(r, c, n): distinct labels (whole numbers below 2^53) within reach rows and columns of each cell; by tiles with a rim."""
    import numpy as np

    def compute(grid):
        at = windows(grid, reach)
        out = np.empty(grid.shape)
        for k in range(grid.shape[0]):  # a row of cells at a time, so that its neighbours' labels stay few
            near = np.sort(np.stack([at(i, j)[k] for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]), axis=0)
            out[k] = (~np.isnan(near)).any(axis=0) + (np.diff(near, axis=0) > 0).sum(axis=0)
        return np.where(np.isnan(grid), np.nan, out)

    return stencil(cells, label, reach, compute, "n").withColumn("n", F.col("n").cast("long"))


def usable_resolution(t: DataFrame, least: float = 0.5) -> DataFrame:
    """(method, res): the coarsest resolution up to which each method's recall stays at or above a floor."""
    w = Window.partitionBy("method").orderBy("res")
    ok = F.min((F.col("recall") >= least).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("ok", ok).filter("ok = 1").groupBy("method").agg(F.max("res").alias("res"))


def at_density(t: DataFrame, density: float) -> DataFrame:
    """(method, metric): the metric of each method interpolated at a density between the two runs around it."""
    w = Window.partitionBy("method").orderBy("density")
    n = t.withColumn("d2", F.lead("density").over(w)).withColumn("m2", F.lead("metric").over(w)).filter(
        (F.col("density") <= density) & (F.col("d2") > density))
    return n.select("method",
        (F.col("metric") + (F.lit(density) - F.col("density")) / (F.col("d2") - F.col("density")) * (F.col(
                    "m2") - F.col("metric"))).alias("metric"))


def radial_spectrum(cells: DataFrame, by: str = "block") -> DataFrame:
    """(by, k, power): mean power at each whole number of waves across a square block, by direction averaged; a block a task.

    The mean is taken off and a Hann window laid over the block. Blocks with gaps give no rows.
    """
    import numpy as np
    import pandas as pd

    def one(key, pdf):
        r, c = pdf.r - pdf.r.min(), pdf.c - pdf.c.min()
        n = int(max(r.max(), c.max())) + 1
        z = np.full((n, n), np.nan)
        z[r, c] = pdf.z
        rows = []
        if n > 2 and not np.isnan(z).any():
            taper = np.hanning(n)
            power = np.abs(np.fft.fft2((z - z.mean()) * np.outer(taper, taper))) ** 2
            waves = np.fft.fftfreq(n) * n
            ring = np.rint(np.hypot(waves[:, None], waves)).astype(int).ravel()
            mean = np.bincount(ring, power.ravel()) / np.maximum(1, np.bincount(ring))
            rows = [(key[0], k, float(v)) for k, v in enumerate(mean) if k]
        return pd.DataFrame(rows, columns=[by, "k", "power"])

    kind = cells.schema[by].dataType.simpleString()
    return cells.select(by, "r", "c", "z").groupBy(by).applyInPandas(one, f"{by} {kind}, k int, power double")


def spectral_slope(spectrum: DataFrame, least: int, most: int, by: str = "block") -> DataFrame:
    """(by, alpha, hurst): how steeply the power falls between two wave numbers, and (alpha - 2) / 2."""
    t = spectrum.filter(F.col("k").between(least, most) & (F.col("power") > 0))
    alpha = -F.regr_slope(F.log("power"), F.log("k"))
    return t.groupBy(by).agg(alpha.alias("alpha"), ((alpha - 2) / 2).alias("hurst"))
