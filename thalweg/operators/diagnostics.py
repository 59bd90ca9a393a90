"""Diagnostics over networks and grids: segment topology, knees, contrasts, rims, valley shape, outcome counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import fixpoint, keep, prefix_sums, walk
from .evaluate import SURE, nearest_by_spots
from .quantiles import exact_quantiles
from .network import upstream_sum
from .routing import RING, farthest_upslope, gather, given_forest
from .slopearea import accepted_stick, binned_break, binned_medians
from .tiles import stencil, windows


def segment_topology(nodes: DataFrame, seg: str = "seg") -> DataFrame:
    """(seg, tostream): where the boundary cell of greatest accumulation of each segment drains to; 0 off the map."""
    to = nodes.select(F.col("node").alias("n2"), F.col(seg).alias("to"))
    j = nodes.filter(F.col(seg).isNotNull()).join(to, F.col("recv") == F.col("n2"), "left").filter(
        (F.col("recv") == F.col("node")) | ~F.col("to").eqNullSafe(F.col(seg)))
    target = F.when(F.col("recv") == F.col("node"), 0).otherwise(F.coalesce("to", F.lit(0)))
    return j.groupBy(seg).agg(F.max_by(target, F.struct("ncontrib", (-F.col("node")).alias("k"))).cast("long").alias("tostream"))


def two_hops(seg: DataFrame) -> DataFrame:
    """(cat, anchor): two segments downstream, or one, or the segment itself."""
    a = seg.select(F.col("cat").alias("c1"), F.nullif("tostream", F.lit(0)).alias("t1"))
    b = seg.select(F.col("cat").alias("c2"), F.nullif("tostream", F.lit(0)).alias("t2"))
    j = seg.select("cat", F.nullif("tostream", F.lit(0)).alias("t0")).join(b, F.col("t0") == F.col("c2"), "left")
    return j.join(a.select("c1"), F.col("t2") == F.col("c1"), "left").select("cat", F.coalesce("t2", "t0", "cat").alias("anchor"))


def knee(points: DataFrame, bins: int = 45, least: int = 30, theta: float = 0.2) -> DataFrame:
    """(peak_x, knee_x): the binned slope's peak and the first bin past it where the local exponent reaches theta."""
    b = binned_medians(points, bins, least)
    w = Window.orderBy("bin")  # at most `bins` rows
    t = b.withColumn("local", -(F.col("y") - F.lag("y").over(w)) / (F.col("x") - F.lag("x").over(w)))
    peak = t.agg(F.max(F.struct("y", (-F.col("bin")).alias("k"), "x")).alias("p")).select(
        (-F.col("p.k")).alias("pb"), F.col("p.x").alias("peak_x"))
    return t.crossJoin(F.broadcast(peak)).groupBy("peak_x").agg(
        F.min(F.when((F.col("bin") > F.col("pb")) & (F.col("local") >= theta), F.struct("bin", "x"))).alias(
            "k")).select("peak_x", F.col("k.x").alias("knee_x"))


def tributary_steps(path: DataFrame, share: float = 0.2) -> DataFrame:
    """Path cells (path, i, node, ncontrib) below which a tributary of at least a share of the trunk joins."""
    w = Window.partitionBy("path").orderBy("i")
    trib = F.lead("ncontrib").over(w) - F.col("ncontrib") - 1
    return path.withColumn("tributary", trib).filter(F.col("tributary") >= share * F.col("ncontrib"))


def cross_contrast(labels: DataFrame, value: str) -> DataFrame:
    """(r, c, contrast): greatest difference to a 4-neighbour of another label."""
    g = gather(labels, ["lab", value], ((-1, 0), (0, 1), (1, 0), (0, -1)))
    return g.select("r", "c",
        F.array_max(F.transform(
            F.filter("near", lambda x: x["v"]["lab"] != F.col("own.lab")),
                lambda x: F.abs(x["v"][value] - F.col(f"own.{value}")))).alias("contrast")).filter(
        "contrast IS NOT NULL")


def rims(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """(top, node, linear, flow): catchment cells of each head with a neighbour outside, and their distances to it.

    A catchment is a run of places in the ordered stack, so a cell lies on its rim if a neighbour is missing or has a
    place outside the run. Catchments below hold those above: a cell that isn't on the rim of one is on none further
    down, so the chains of heads are followed for the cells on the rim of their first one alone.
    """
    near, forest = given_forest(nodes, heads)
    place = keep(ordered_stack(nodes).join(nodes.select(F.col("node").alias("n2"), "r", "c", "fd", "ncontrib"), F.col("node") == F.col("n2")).drop("n2"), "places")
    g = gather(place, ["node", "place"])
    around = g.select(
        F.col("own.node").alias("node"), (F.size("near") < len(RING)).alias("bare"), F.array_min(F.transform("near", lambda x: x["v"]["place"])).alias("lo"),
        F.array_max(F.transform("near", lambda x: x["v"]["place"])).alias("hi"))
    run = place.select(F.col("node").alias("top"), F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("fd").alias("fd0"), F.col("place").alias("first"), F.col("ncontrib").alias("size"))
    outside = F.col("bare") | (F.col("lo") < F.col("first")) | (F.col("hi") >= F.col("first") + F.col("size"))
    edge = keep(near.join(around, "node").join(run, F.col("at") == F.col("top")).filter(outside).select("node", "at", "bare", "lo", "hi"), "edge")
    chain = walk(keep(forest.filter("next IS NOT NULL").select(F.col("top").alias("node"), F.col("next").alias("to")), "chain"),
        heads.select(F.col("node").alias("start")).distinct())
    met = edge.join(chain.select("start", F.col("node").alias("top")), F.col("at") == F.col("start")).join(run, "top").filter(outside)
    here = place.select("node", "r", "c", "fd")
    return met.join(here, "node").select(
        "top", "node", F.sqrt((F.col("r") - F.col("r0")) ** 2 + (F.col("c") - F.col("c0")) ** 2).alias("linear"),
        (F.col("fd") - F.col("fd0")).alias("flow"))


def valley_axes(points: DataFrame, by: str = "id") -> DataFrame:
    """(by, n, long, short, aspect): principal standard deviations of each set of points (x, y)."""
    m = points.groupBy(by).agg(F.count("*").alias("n"), F.var_pop("x").alias("a"), F.var_pop("y").alias("d"), F.covar_pop("x", "y").alias("b"))
    half, root = (F.col("a") + F.col("d")) / 2, F.sqrt(((F.col("a") - F.col("d")) / 2) ** 2 + F.col("b") ** 2)
    long, short = F.sqrt(half + root), F.sqrt(F.greatest(F.lit(0.0), half - root))
    return m.select(by, "n", long.alias("long"), short.alias("short"), (long / F.nullif(short, F.lit(0.0))).alias("aspect"))


def surface(cells: DataFrame, size: float = 1.0) -> DataFrame:
    """(r, c, gradient, laplacian) by central differences; cells without all four neighbours are left out."""
    g = gather(cells, ["z"], ((-1, 0), (0, 1), (1, 0), (0, -1))).filter("size(near) = 4")
    at = lambda k: F.element_at(F.filter("near", lambda x: x["k"] == k), 1)["v"]["z"]
    n, e, s, w, z = at(0), at(1), at(2), at(3), F.col("own.z")
    return g.select("r", "c", (F.sqrt((e - w) ** 2 + (n - s) ** 2) / (2 * size)).alias("gradient"),
        ((n + e + s + w - 4 * z) / (size * size)).alias("laplacian"))


def smooth(cells: DataFrame, sigma: float) -> DataFrame:
    """(r, c, z): Gaussian means over the cells that are there, cut at three sigma; by tiles with a rim."""
    import numpy as np

    k = max(1, math.ceil(3 * sigma))

    def compute(grid):
        at, total, weight = windows(grid, k), np.zeros(grid.shape), np.zeros(grid.shape)
        for i in range(-k, k + 1):
            for j in range(-k, k + 1):
                w, z = math.exp(-(i * i + j * j) / (2 * sigma * sigma)), at(i, j)
                total += w * np.nan_to_num(z)
                weight += w * ~np.isnan(z)
        return total / np.where(weight > 0, weight, np.nan)

    return stencil(cells, "z", k, compute, "z")


def signature_match(a: DataFrame, b: DataFrame, scales: dict[str, float]) -> DataFrame:
    """(id_a, id_b, d2): the nearest b within one scaled unit of each a, met in cells of the scales, or of shares of them
    where points are crowded."""
    names = list(scales)
    offs = [[]]
    for _ in names:
        offs = [o + [k] for o in offs for k in (-1, 0, 1)]
    around = F.explode(F.array(*(F.struct(*(F.lit(k).alias(n) for n, k in zip(names, o, strict=True))) for o in offs)))
    d2 = sum((((F.col(f"a_{n}") - F.col(f"b_{n}")) / s) ** 2 for n, s in scales.items()), F.lit(0.0))

    def meet(x: DataFrame, y: DataFrame, share: float) -> DataFrame:
        grid = {n: F.floor(F.col(n) / (s * share)) for n, s in scales.items()}
        left = x.select(F.col("id").alias("id_a"), *(F.col(n).alias(f"a_{n}") for n in names),
            *(grid[n].alias(f"ga_{n}") for n in names)).withColumn("o", around)
        left = left.select("id_a", *(f"a_{n}" for n in names), *((F.col(f"ga_{n}") + F.col(f"o.{n}")).alias(f"g_{n}") for n in names))
        right = y.select(F.col("id").alias("id_b"), *(F.col(n).alias(f"b_{n}") for n in names), *(grid[n].alias(f"g_{n}") for n in names))
        most = 1.0 if share == 1 else SURE * share * share
        return left.join(right, [f"g_{n}" for n in names]).withColumn("d2", d2).filter(F.col("d2") < most).groupBy("id_a").agg(
            F.min(F.struct("d2", "id_b")).alias("m")).select("id_a", "m.id_b", "m.d2")

    return nearest_by_spots(a, b, scales, meet, "d2")


#: Points of a pool up to which it is taken whole in one task, with the pools inside it.
POOL_POINTS = 200_000
#: Parts that an interval with a wanted rank is cut into each pass.
POOL_CUTS = 128


def _block_medians(least: int, bins: int, per_bin: int):
    """(cat, x, y) of the pools of one tree of segments (cat, to, x, y; a row a point, one without for an empty segment).

    Segments are put in an order in which each pool's points stand together, so a pool is a slice.
    """
    import numpy as np

    def of(cat, to, x, y):
        names, first, at = np.unique(cat, return_index=True, return_inverse=True)
        place = np.searchsorted(names, to[first])
        inside = (place < len(names)) & (names[np.minimum(place, len(names) - 1)] == to[first])
        above: list[list[int]] = [[] for _ in names]
        for k in np.flatnonzero(inside):
            above[place[k]].append(k)
        number, end, n = np.empty(len(names), np.int64), np.empty(len(names), np.int64), 0
        todo = [(int(k), False) for k in np.flatnonzero(~inside)]
        while todo:
            k, left = todo.pop()
            if left:
                end[k] = n
            else:
                number[k], n = n, n + 1
                todo.append((k, True))
                todo += [(j, False) for j in above[k]]
        real = ~np.isnan(x)
        x, y, turn = x[real], y[real], number[at[real]]
        order = np.argsort(turn, kind="stable")
        x, y, turn = x[order], y[order], turn[order]
        starts, ends = np.searchsorted(turn, number), np.searchsorted(turn, end)
        for k in np.flatnonzero(ends - starts >= least):
            u, v = x[starts[k]:ends[k]], y[starts[k]:ends[k]]
            lo, hi = u.min(), u.max()
            if not hi > lo:
                continue
            v, u = v[u < hi], u[u < hi]
            with np.errstate(invalid="ignore"):
                zone = np.minimum(bins - 1, np.nan_to_num(np.floor((u - lo) / ((hi - lo) / bins)), nan=0.0)).astype(int)
            sizes = np.bincount(zone, minlength=bins)
            some = np.flatnonzero(sizes >= per_bin)
            if not len(some):
                continue
            low = (np.cumsum(sizes) - sizes)[some] + (sizes[some] - 1) // 2
            high = (np.cumsum(sizes) - sizes)[some] + sizes[some] // 2
            mids = []
            for t in (u, v):
                t = t[np.lexsort((t, zone))]
                mids.append(t[low] + 0.5 * (t[high] - t[low]))
            yield int(names[k]), *mids

    return of


def _large_medians(rows: DataFrame, per_bin: int) -> DataFrame:
    """(top, bin, x, y): medians of few groups (top, bin) of very many rows (x, y), by counts in parts of intervals.

    Rows are read again each pass and never move; what moves are counts of a task's groups.
    """
    t = rows.select("top", "bin", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("x").alias("v")), F.struct(F.lit(1).alias("k"), F.col("y").alias("v")))).alias("e")).select("top", "bin", "e.*")
    of = ["top", "bin", "k"]
    whole = t.groupBy(*of).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).filter(F.col("n") >= per_bin)
    ranks = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    spans = keep(whole.select(*of, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below")), "spans")
    v, lo, hi = F.col("v"), F.greatest(F.col("lo"), F.lit(-1.7e308)), F.least(F.col("hi"), F.lit(1.7e308))
    share = F.when(hi - lo < math.inf, (v - lo) / (hi - lo)).otherwise((v / 4 - lo / 4) / (hi / 4 - lo / 4))
    part = F.when(v == -math.inf, -1).when(v == math.inf, POOL_CUTS).otherwise(F.least(F.lit(POOL_CUTS - 1), F.floor(share * POOL_CUTS).cast("int")))
    w = Window.partitionBy(*of, "rank").orderBy("part")
    while (still := spans.filter("lo < hi")).limit(1).count():
        met = t.join(F.broadcast(still), of).filter(v.between(F.col("lo"), F.col("hi")))
        counts = met.groupBy(*of, "rank", "below", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("below") + F.sum("n").over(w)
        one = counts.withColumn("upto", upto).filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        spans = keep(spans.filter("lo = hi").unionByName(one.select(*of, "rank", "lo", "hi", (F.col("upto") - F.col("n")).alias("below"))), "spans")
    mid = lambda k: F.min(F.when(F.col("k") == k, F.col("lo"))) + 0.5 * (F.max(F.when(F.col("k") == k, F.col("lo"))) - F.min(F.when(F.col("k") == k, F.col("lo"))))
    return spans.groupBy("top", "bin").agg(mid(0).alias("x"), mid(1).alias("y"))


def accumulate_and_prune(seg: DataFrame, v: DataFrame, gate=accepted_stick, least: int = 20, bins: int = 18, per_bin: int = 8, most: int = POOL_POINTS) -> DataFrame:
    """(cat, logA_star, theta): segments whose ancestors' pooled cloud passes `gate` and that none taken before them holds.

    A segment's pool are its own points and those of all that drain through it, at least `least` of them; gate(x, y) is
    asked about the medians of its equal-width bins of at least per_bin points and gives (logA_star, theta) or None.
    Segments are taken by rising greatest area (then cat), and what is taken takes its ancestors with it.

    A point is sent to one block, the largest pool it is in of up to `most` points, which one task takes with all pools
    inside it; no row is made for a point and each pool it is in. Medians of the few larger pools come from counts
    (`_large_medians`). Only where an ancestor has the greater area does it matter who comes first; such pairs alone
    are settled, in rounds.
    """
    here = seg.select(F.col("cat").alias("c2"))
    steps = seg.select(F.col("cat").alias("node"), F.col("tostream").alias("to")).join(here, F.col("to") == F.col("c2"), "left_semi")
    pairs = keep(walk(steps, seg.select(F.col("cat").alias("start"))).select(F.col("start").alias("cat"), F.col("node").alias("top")), "pools")
    points = v.filter("logA IS NOT NULL AND logS IS NOT NULL AND NOT isnan(logA)").select("cat", F.col("logA").cast("double").alias("x"), F.col("logS").cast("double").alias("y"))
    own = keep(points.groupBy("cat").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")), "own")
    ends = keep(pairs.join(own, "cat").groupBy("top").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")), "ends")
    need = max(least, 2 * per_bin)
    most = max(most, need)
    large = ends.filter(F.col("n") > most).select("top", "lo", "hi")
    to = seg.select(F.col("cat").alias("top"), F.col("tostream").alias("to"))
    # the topmost pools that aren't large: one for each segment that is in none
    roots = ends.filter(F.col("n") <= most).join(to, "top").join(large.select(F.col("top").alias("to")), "to", "left_semi").select("top", "n").union(
        ends.filter(F.col("n") <= most).join(to, "top").join(here, F.col("to") == F.col("c2"), "left_anti").select("top", "n"))
    roots = keep(roots, "roots")
    home = pairs.join(roots, "top").select("cat", F.col("top").alias("home"), (F.col("n") >= need).alias("whole"))
    many = bool(large.limit(1).count())
    if many:
        home = home.union(large.select("top", "top", F.lit(False)))
    rows = seg.select("cat", F.col("tostream").alias("to")).join(home, "cat").join(points, "cat", "left")
    if many:
        rows = keep(rows.repartition("home"), "blocks")

    def fitted(got):
        import pandas as pd

        got = [(c, gate(x, y)) for c, x, y in got]
        return pd.DataFrame([(c, *g[:2]) for c, g in got if g is not None], columns=["cat", "logA_star", "theta"]).astype({"cat": "int64", "logA_star": float, "theta": float})

    of_block = _block_medians(need, bins, per_bin)

    def block(pdf):
        return fitted(of_block(*(pdf[c].to_numpy(k) for c, k in (("cat", "int64"), ("to", "int64"), ("x", float), ("y", float)))))

    def asked(frames):
        import numpy as np

        for pdf in frames:
            yield fitted((c, np.array(x, float), np.array(y, float)) for c, x, y in zip(pdf["cat"], pdf["x"], pdf["y"]))

    schema = "cat long, logA_star double, theta double"
    passed = rows.filter("whole").select("home", "cat", F.coalesce("to", F.lit(0)).alias("to"), "x", "y").groupBy("home").applyInPandas(lambda pdf: block(pdf), schema)
    if many:
        # the large pools that a block is in: a row a block, and as many pools as are large on its way down
        on = pairs.join(large.filter(F.col("hi") > F.col("lo")), "top").join(roots.select(F.col("top").alias("cat")).union(large.select("top")), "cat", "left_semi")
        lists = on.groupBy(F.col("cat").alias("home")).agg(F.collect_list(F.struct("top", "lo", "hi")).alias("tops"))
        each = rows.filter("x IS NOT NULL").join(F.broadcast(lists), "home").select("x", "y", F.explode("tops").alias("e")).select("x", "y", "e.*").filter(F.col("x") < F.col("hi"))
        at = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("int"))
        mids = _large_medians(each.select("top", at.alias("bin"), "x", "y"), per_bin)
        clouds = mids.groupBy(F.col("top").alias("cat")).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("m"))  # a few bins each
        passed = passed.union(clouds.select("cat", F.col("m.x").alias("x"), F.col("m.y").alias("y")).mapInPandas(asked, schema))
    passed = keep(passed, "passed")
    turn = passed.select("cat").join(own.select("cat", "hi"), "cat", "left").select("cat", F.struct(F.coalesce("hi", F.lit(float("-inf"))), "cat").alias("turn"))
    mine, theirs = (turn.select(F.col("cat").alias(c), F.col("turn").alias(f"turn_{c}")) for c in ("cat", "top"))
    # a passing ancestor whose turn comes after that of a passing segment below it
    rivals = keep(pairs.filter("cat <> top").join(mine, "cat").join(theirs, "top").filter(F.col("turn_top") < F.col("turn_cat")).select("cat", "top"), "rivals")
    left = passed.select("cat")
    while rivals.limit(1).count():
        # those that wait for nobody stand, what they hold goes, and so do the claims of what has gone
        waits = rivals.select("cat").distinct()
        stands = left.join(waits, "cat", "left_anti").select(F.col("cat").alias("top"))
        gone = keep(rivals.join(stands, "top", "left_semi").select("cat").distinct(), "gone")
        left = keep(left.join(gone, "cat", "left_anti"), "left")
        rivals = keep(rivals.join(gone, "cat", "left_anti").join(gone.select(F.col("cat").alias("top")), "top", "left_anti"), "rivals")
    return passed.join(left, "cat", "left_semi")


def local_threshold(stars: DataFrame, members: DataFrame, v: DataFrame) -> DataFrame:
    """Vertices whose area reaches the threshold of the finest hollow (least A_star) their segment belongs to."""
    own = members.join(stars, members["hollow"] == stars["cat"]).groupBy(members["seg"]).agg(F.min("logA_star").alias("star"))
    return v.join(own, v["cat"] == own["seg"]).filter("logA >= star").drop("seg")


def detection_by_scale(t: DataFrame, bins: int = 12) -> DataFrame:
    """(bin, n, share): detected fraction on equal-width bins of the log of a scale ratio."""
    e = t.agg(F.log10(F.min("ratio")).alias("lo"), F.log10(F.max("ratio")).alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.log10("ratio") - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))))
    return t.crossJoin(F.broadcast(e)).groupBy(F.coalesce(b, F.lit(0)).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.avg(F.col("found").cast("double")).alias("share"))


def wrap(v: DataFrame, window: int = 3, by: str = "cat") -> DataFrame:
    """(by, seq, angle): turning angle of each polyline, smoothed over 2 * window + 1 vertices, in radians."""
    w = Window.partitionBy(by).orderBy("seq")
    near = w.rowsBetween(-window, window)
    t = v.withColumn("_x", F.avg("x").over(near)).withColumn("_y", F.avg("y").over(near))
    ax, ay, bx, by_ = F.col("_x") - F.lag("_x").over(w), F.col("_y") - F.lag("_y").over(w), F.lead("_x").over(
        w) - F.col("_x"), F.lead("_y").over(w) - F.col("_y")
    t = t.withColumn("_c", (ax * bx + ay * by_) / F.nullif(F.sqrt((ax * ax + ay * ay) * (bx * bx + by_ * by_)), F.lit(0.0)))
    return t.select(by, "seq", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_c")))).alias("angle"))


def node_index(cells: DataFrame) -> DataFrame:
    """(r, c, idx): rank of each cell in row-major order from 0."""
    return prefix_sums(cells.select("r", "c"), ["r", "c"], F.lit(1).cast("long"), "place").select("r", "c", (F.col("place") - 1).alias("idx"))


def downstream_sum(nodes: DataFrame, term) -> DataFrame:
    """(node, total): sum of a term (a column of nodes) over the path from each node to base level, the last node's left out."""
    down = F.when(F.col("recv") != F.col("node"), F.col("recv"))
    start = nodes.select("node", down.alias("jump"), F.when(down.isNotNull(), term).otherwise(0.0).alias("total"))

    def step(cur: DataFrame) -> DataFrame:
        to = cur.select(F.col("node").alias("n2"), F.col("jump").alias("j2"), F.col("total").alias("t2"))
        moved = cur.filter("jump IS NOT NULL").join(to, F.col("jump") == F.col("n2"), "left").select(
            "node", F.col("j2").alias("jump"), (F.col("total") + F.coalesce("t2", F.lit(0.0))).alias("total"))
        return cur.filter("jump IS NULL").unionByName(moved)

    return fixpoint(start, step, "jump IS NOT NULL").drop("jump")


def ordered_stack(nodes: DataFrame) -> DataFrame:
    """(node, place): each node's place, from 0, in the stack that lists every node before those that drain through it.

    Base levels and donors come in the order of their ids. A node's place is its receiver's plus one and
    the sizes of the trees of donors before it, so places are sums along flow paths; a node's upslope set
    is the run of ncontrib places from its own.
    """
    sibling = Window.partitionBy("recv").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    inner = nodes.filter("recv <> node").withColumn("own", 1 + F.coalesce(F.sum("ncontrib").over(sibling), F.lit(0)))
    tops = prefix_sums(nodes.filter("recv = node"), ["node"], F.col("ncontrib"), "upto").withColumn(
        "own", F.col("upto") - F.col("ncontrib")).drop("upto")
    t = keep(inner.unionByName(tops).select("node", "recv", "root", F.col("own").cast("double").alias("own")), "stack")
    base = t.filter("recv = node").select(F.col("node").alias("base"), F.col("own").alias("first"))
    return downstream_sum(t, F.col("own")).join(
        t.select(F.col("node").alias("n2"), "root"), F.col("node") == F.col("n2")).join(
        base, F.col("root") == F.col("base")).select(
        "node", (F.col("total") + F.col("first")).cast("long").alias("place"))


def claimed_cells(nodes: DataFrame, mouths: DataFrame) -> DataFrame:
    """(node, mouth): the catchment each cell belongs to; of nested ones that of the largest mouth.

    Areas grow downstream, so that is the last mouth on the cell's way down: the first one, and then the end of the
    mouths' own chain, by doubling.
    """
    near, forest = given_forest(nodes, mouths)

    def step(cur: DataFrame) -> DataFrame:
        on = cur.select(F.col("top").alias("t2"), F.col("jump").alias("j2"), F.col("last").alias("l2"))
        moved = cur.filter("jump IS NOT NULL").join(on, F.col("jump") == F.col("t2")).select("top", F.col("j2").alias("jump"), F.col("l2").alias("last"))
        return cur.filter("jump IS NULL").unionByName(moved)

    last = fixpoint(forest.select("top", F.col("next").alias("jump"), F.col("top").alias("last")), step, "jump IS NOT NULL")
    return near.join(last, F.col("at") == F.col("top")).select("node", F.col("last").alias("mouth"))


def stream_corners(channel: DataFrame, ncols: int) -> DataFrame:
    """(corner): corners that touch a channel cell (r, c)."""
    at = F.explode(F.array(*((F.col("r") + i) * (ncols + 1) + F.col("c") + j for i in (0, 1) for j in (0, 1))))
    return channel.select(at.alias("corner")).select(F.col("corner").cast("long").alias("corner")).distinct()


def criteria_drift(t: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, median, iqr, cv): median, interquartile range and population coefficient of variation of a criterion at each resolution."""
    got = exact_quantiles(t, value, [0.25, 0.5, 0.75], by)  # few resolutions
    mids = t.sparkSession.createDataFrame(
        [(g, q[1], q[2] - q[0]) for g, q in got.items()],
        f"{by} {t.schema[by].dataType.simpleString()}, median double, iqr double")
    per = t.groupBy(by).agg(F.count("*").alias("n"), (F.stddev_pop(value) / F.nullif(F.avg(value), F.lit(0.0))).alias("cv"))
    return per.join(F.broadcast(mids), by, "left").select(by, "n", "median", "iqr", "cv")


def floodplain_cut(cells: DataFrame, flat: float = 1e-3, most: float = 0.4, bands: int = 50) -> DataFrame:
    """One row: the lower end of the lowest elevation band (of `bands` equal shares) whose flat share is under `most`."""
    cells = keep(cells.select("z", "slope"), "cells")
    cuts = exact_quantiles(cells, "z", [k / bands for k in range(bands + 1)]).get(None, [])
    p = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    per = cells.withColumn(
        "band", F.least(F.lit(bands - 1), F.size(F.filter(p, lambda x: x <= F.col("z"))) - 1)).groupBy("band").agg(
        F.avg((F.col("slope") < flat).cast("double")).alias("share"))
    return per.filter(F.col("share") < most).agg(F.min("band").alias("band")).select("band", F.get(p, F.col("band")).alias("z"))


def false_negatives(cells: DataFrame, hollows: DataFrame, tol_area: float = 0.30, tol_slope: float = 0.30,
    reach: float = 300.0, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """Unresolved cells (id, x, y, logA, logS, seg) that look like a found hollow: (cells with missed, branches).

    missed: within one unit of a hollow in log area, log slope and distance, each over its tolerance.
    branches: (seg, n, n_missed, share) of segments with enough cells.
    """
    scales = {"logA": tol_area, "logS": tol_slope, "x": reach, "y": reach}
    hit = signature_match(cells, hollows, scales).select(F.col("id_a").alias("id"))
    marked = cells.join(hit.withColumn("_hit", F.lit(True)), "id", "left").withColumn("missed", F.coalesce("_hit", F.lit(False))).drop("_hit")
    per = marked.filter("seg IS NOT NULL").groupBy("seg").agg(
        F.count("*").alias("n"), F.count_if("missed").alias("n_missed")).filter(F.col("n") >= least)
    return marked, per.withColumn("share", F.col("n_missed") / F.col("n"))


def coverage(seg: DataFrame, v: DataFrame, cells: DataFrame) -> DataFrame:
    """(cat, max_area, n_cells, ratio): cells (lab) in the basins of a segment and its ancestors against its greatest area."""
    own = seg.select("cat", "tostream").join(
        cells.groupBy(F.col("lab").alias("cat")).agg(F.count("*").alias("own")), "cat", "left").fillna(0, ["own"])
    most = v.groupBy("cat").agg(F.max("A").alias("max_area"))
    got = upstream_sum(own, "own").join(most, "cat")
    return got.select(
        "cat", "max_area", F.col("total").cast("long").alias("n_cells"),
        (F.col("total") / F.greatest(F.lit(1.0), "max_area")).alias("ratio"))


def classify_segments(seg: DataFrame, ends: DataFrame, labels: DataFrame, ncols: int) -> DataFrame:
    """(seg, n, ring, beside_missing): divide segments that close on themselves, and those at a corner of a cell without a label."""
    bare = stream_corners(labels.filter("lab = -1"), ncols).select(F.col("corner").alias("k"))
    at = seg.select("seg", F.explode(F.array("a", "b")).alias("corner")).join(bare, F.col("corner") == F.col("k"), "left")
    beside = at.groupBy("seg").agg(F.max(F.col("k").isNotNull()).alias("beside_missing"))
    return ends.join(beside, "seg").select("seg", "n", F.col("u").isNull().alias("ring"), "beside_missing")


def lowest_parabolas(at: list[int], height: list[int]) -> tuple[list[int], list[int]]:
    """(which, since): the parabolas (x - at)^2 + height that are least, and the whole x from which each is; at rises."""
    which: list[int] = []
    since: list[int] = []
    for i, (a, h) in enumerate(zip(at, height, strict=True)):
        first = -(1 << 62)
        while which:
            j = which[-1]
            first = (a * a - at[j] * at[j] + h - height[j]) // (2 * (a - at[j])) + 1
            if first > since[-1]:
                break
            which.pop()
            since.pop()
        which.append(i)
        since.append(first if len(which) > 1 else -(1 << 62))
    return which, since


def distance_to_channel(nodes: DataFrame, channel: DataFrame) -> DataFrame:
    """(node, d): distance in cells from each node (node, r, c) to the nearest channel cell (r, c), however far; none: no rows.

    Down each column the rows learn how far its nearest channel cell is; along each row the least of the columns is read
    off the lowest parabolas. No pair of a node and a channel cell is made: two exchanges, a row of the grid to a group.
    """
    import numpy as np
    import pandas as pd

    bounds = nodes.agg(F.min("r").alias("top"), F.max("r").alias("bottom"))  # one row
    w = Window.partitionBy("c").orderBy("r")
    runs = channel.select("r", "c").distinct().withColumns({"up": F.lag("r").over(w), "down": F.lead("r").over(w)}).crossJoin(F.broadcast(bounds))
    first = F.greatest("top", F.floor((F.col("up") + F.col("r")) / 2) + 1)  # nulls don't count
    last = F.least("bottom", F.floor((F.col("r") + F.col("down")) / 2))
    near = runs.select("c", F.col("r").alias("at"), first.cast("long").alias("first"), last.cast("long").alias("last")).filter("first <= last").select(
        "c", "at", F.explode(F.sequence("first", "last")).alias("r")).select(
        "r", F.col("c").cast("long").alias("c"), ((F.col("r") - F.col("at")) ** 2).cast("long").alias("g"))

    def row(own: pd.DataFrame, cols: pd.DataFrame) -> pd.DataFrame:
        if own.empty or cols.empty:
            return pd.DataFrame({"node": np.empty(0, np.int64), "d": np.empty(0)})
        cols = cols.sort_values("c")
        which, since = lowest_parabolas(cols.c.tolist(), cols.g.tolist())
        best = np.array(which)[np.searchsorted(since, own.c.to_numpy(), "right") - 1]
        at, g = cols.c.to_numpy()[best], cols.g.to_numpy()[best]
        return pd.DataFrame({"node": own.node, "d": np.sqrt(((own.c.to_numpy() - at) ** 2 + g).astype(float))})

    own = nodes.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("node").cast("long").alias("node"))
    return own.groupBy("r").cogroup(near.groupBy("r")).applyInPandas(row, "node long, d double")


def apexes(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """(node, apex, flow, relief, straight): from each given node to its farthest upslope node."""
    top = farthest_upslope(nodes, at)
    here = nodes.select(F.col("node").alias("top"), "r", "c", "z", "fd")
    there = nodes.select(
        F.col("node").alias("hilltop"), F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("z").alias("z2"),
        F.col("fd").alias("fd2"))
    straight = F.sqrt((F.col("r2") - F.col("r")) ** 2 + (F.col("c2") - F.col("c")) ** 2)
    return top.join(here, "top").join(there, "hilltop").select(
        F.col("top").alias("node"), F.col("hilltop").alias("apex"), (F.col("fd2") - F.col("fd")).alias("flow"),
        (F.col("z2") - F.col("z")).alias("relief"), straight.alias("straight"))


def apex_control(nodes: DataFrame, heads: DataFrame, most: int | None = 500) -> DataFrame:
    """(group, n, mean, sd, cv of flow): heads against other channel nodes with areas like theirs.

    The control is of nodes between the tenth and ninetieth percentile of the heads' areas, at most `most`
    of them by the smallest hash of the node (a sample is what is asked for; None: all).
    """
    mine = nodes.join(heads.select("node").distinct(), "node", "left_semi")
    lo, hi = exact_quantiles(mine, "ncontrib", [0.1, 0.9]).get(None, (None, None))
    pool = nodes.filter(F.col("ncontrib").between(lo, hi))
    if most is not None:
        pool = pool.orderBy(F.xxhash64("node"), "node").limit(most)
    both = apexes(nodes, mine).withColumn("group", F.lit("heads")).unionByName(apexes(nodes, pool).withColumn("group", F.lit("control")))
    return both.groupBy("group").agg(
        F.count("*").alias("n"), F.avg("flow").alias("mean"), F.stddev_pop("flow").alias("sd"),
        (F.stddev_pop("flow") / F.nullif(F.avg("flow"), F.lit(0.0))).alias("cv"))


def outcome_census(t: DataFrame, by: str, outcome: str) -> DataFrame:
    """(by, outcome, n, share): how often each outcome comes in each group, and its share of the group."""
    n = t.groupBy(by, outcome).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def spatial_halves(points: DataFrame, axis: str = "x") -> DataFrame:
    """Points with side: 0 up to the median of a coordinate, 1 beyond it."""
    (mid,) = exact_quantiles(points, axis, [0.5]).get(None, [None])
    return points.withColumn("side", (F.col(axis) > F.lit(mid)).cast("int"))


def compare_sides(points: DataFrame) -> DataFrame:
    """(side, n, median_logS, theta): slope-area figures of each side."""
    got = exact_quantiles(points, "logS", [0.5], "side")
    mids = points.sparkSession.createDataFrame([(g, m[0]) for g, m in got.items()], "side int, median_logS double")
    return points.groupBy("side").agg(F.count("*").alias("n"), F.regr_slope("logS", "logA").alias("theta")).join(
        mids, "side").select("side", "n", "median_logS", "theta")


def area_ratio(t: DataFrame, found: str, known: str, close: float = 2.0, star: float | None = None) -> DataFrame:
    """One row of the ratio found / known: p25, p50, p75, mean and sd of its log10, shares within a factor `close` and found below star."""
    r = t.filter((F.col(found) > 0) & (F.col(known) > 0)).select(
        F.log10(F.col(found) / F.col(known)).alias("x"), (F.col(found) < F.lit(star)).alias("low"))
    r = keep(r, "ratios")
    p = exact_quantiles(r, "x", [0.25, 0.5, 0.75]).get(None, [None] * 3)
    return r.agg(*(F.lit(v).cast("double").alias(n) for n, v in zip(("p25", "p50", "p75"), p)),
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"),
        F.avg((F.abs("x") <= math.log10(close)).cast("double")).alias("close"),
        F.avg(F.col("low").cast("double")).alias("below"))


def slope_floor_sweep(points: DataFrame, floors: list[float]) -> DataFrame:
    """(floor, n, logA_star, theta, R, accepted): the binned stick of the cloud above each least slope (logS)."""
    points = keep(points.select("logA", "logS"), "cloud")
    rows = []
    for f in floors:
        above = points.filter(F.col("logS") >= f)
        got = binned_break(above).first()
        rows.append((float(f), above.count(), *((got.logA_star, got.theta, got.R, got.accepted) if got else (None, None, None, False))))
    return points.sparkSession.createDataFrame(rows, "floor double, n long, logA_star double, theta double, R double, accepted boolean")


def donor_counts(nodes: DataFrame) -> DataFrame:
    """(node, n): how many nodes drain straight into each."""
    return nodes.filter("recv <> node").groupBy(F.col("recv").alias("node")).agg(F.count("*").alias("n"))


def descent_slopes(nodes: DataFrame, res: float = 1.0) -> DataFrame:
    """(node, slope): drop to the receiver over the distance to it."""
    b = nodes.select(F.col("node").alias("n2"), F.col("z").alias("z2"))
    reach = F.when(F.col("flc") == 2, math.sqrt(2.0) * res).otherwise(res)
    return nodes.filter("recv <> node").join(b, F.col("recv") == F.col("n2")).select("node", ((F.col("z") - F.col("z2")) / reach).alias("slope"))


def givers(nodes: DataFrame, ncols: int, nrows: int) -> DataFrame:
    """(giver, receiver) of each draining node, numbered down the columns."""
    down = lambda n: (F.col(n) % ncols) * nrows + F.expr(f"{n} div {ncols}")
    return nodes.filter("recv <> node").select(down("node").cast("long").alias("giver"), down("recv").cast("long").alias("receiver"))


def drainage_density(nodes: DataFrame, threshold: int, res: float = 1.0) -> DataFrame:
    """One row: length of channel (steps of nodes of at least threshold cells) over the area of all nodes."""
    step = F.when(F.col("flc") == 2, math.sqrt(2.0) * res).when(F.col("flc") == 1, res).otherwise(0.0)
    return nodes.agg((F.sum(F.when(F.col("ncontrib") >= threshold, step).otherwise(0.0)) / (F.count("*") * res * res)).alias("density"))


def basin_cells(labels: DataFrame) -> DataFrame:
    """(lab, n, first): cells of each basin and its first node."""
    return labels.groupBy("lab").agg(F.count("*").alias("n"), F.min("node").alias("first"))


def top_by(t: DataFrame, value: str, n: int, key: str = "cat") -> DataFrame:
    """The n rows of the largest value, equal ones by key."""
    return t.orderBy(F.desc(value), key).limit(n)
