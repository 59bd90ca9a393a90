"""Channel heads from chi-elevation profiles and from valleys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import keep, nearest_below, prefix_sums, together, walk
from .network import OUTLET, strahler
from .paths import along
from .routing import downstream_of, farthest_upslope, sources, steps_of


def split_scores(p: DataFrame, least: int = 10, by: str = "profile") -> DataFrame:
    """(by, i, score) of every split of each profile (i, chi, z from the hilltop down) into hillslope and channel.

    Score = R2 of the channel part - (Durbin-Watson of the hillslope part - 2) / 2. Running sums from
    either end give both regressions at every split at once, so a profile costs its length.
    """
    whole = Window.partitionBy(by)
    w = whole.orderBy("i")
    t = p.withColumn("n", F.count("*").over(whole)).filter(F.col("n") >= 2 * least)
    t = t.withColumn("x", F.col("chi") - F.avg("chi").over(whole)).withColumn("y", F.col("z") - F.avg("z").over(whole))
    t = t.withColumn("dx", F.coalesce(F.col("x") - F.lag("x").over(w), F.lit(0.0))).withColumn(
        "dy", F.coalesce(F.col("y") - F.lag("y").over(w), F.lit(0.0)))
    t = t.withColumn("pos", F.row_number().over(w) - 1)
    above, below = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    x, y = F.col("x"), F.col("y")

    def sums(frame, count):
        s = {k: F.sum(e).over(frame) for k, e in (("x", x), ("y", y), ("xx", x * x), ("xy", x * y), ("yy", y * y))}
        return s["xx"] - s["x"] * s["x"] / count, s["xy"] - s["x"] * s["y"] / count, s["yy"] - s["y"] * s["y"] / count

    hx, hxy, hy = sums(above, F.nullif("pos", F.lit(0)))
    cx, cxy, cy = sums(below, F.col("n") - F.col("pos"))
    t = t.withColumns(
        {"hx": hx, "hxy": hxy, "hy": hy, "cx": cx, "cxy": cxy, "cy": cy,
            "ddx": F.sum(F.col("dx") * F.col("dx")).over(above), "dxy": F.sum(F.col("dx") * F.col("dy")).over(above),
            "ddy": F.sum(F.col("dy") * F.col("dy")).over(above)})
    t = t.filter((F.col("pos") >= least) & (F.col("n") - F.col("pos") >= least))
    tiny = lambda s, q: F.abs(F.col(s)) <= 1e-12 * F.greatest(F.col(q), F.lit(1e-300))
    m = F.col("hxy") / F.nullif("hx", F.lit(0.0))
    sse = F.col("hy") - m * F.col("hxy")
    dw = (m * m * F.col("ddx") - 2 * m * F.col("dxy") + F.col("ddy")) / F.when(sse <= 0, 1e-10).otherwise(sse)
    r2 = F.col("cxy") * F.col("cxy") / F.nullif(F.col("cx") * F.col("cy"), F.lit(0.0))
    score = F.when(F.col("cx") == 0, 0.0).otherwise(F.coalesce(r2, F.lit(0.0))) - (F.coalesce(dw, F.lit(2.0)) - 2) / 2
    return t.select(by, "i", "pos", score.alias("score"))


def chi_split(p: DataFrame, least: int = 10, by: str = "profile") -> DataFrame:
    """(by, i, score): the best split of each profile, the first of equal ones; short profiles give none."""
    s = split_scores(p, least, by)
    return s.groupBy(by).agg(F.max(F.struct("score", (-F.col("pos")).alias("k"), "i")).alias("b")).select(
        by, F.col("b.i").alias("i"), F.col("b.score").alias("score"))


def uppermost_split(p: DataFrame, least: int = 10, share: float = 0.9, by: str = "profile") -> DataFrame:
    """(by, i, score): the first local maximum of the score that reaches a share of the largest; else the largest."""
    s = split_scores(p, least, by)
    whole = Window.partitionBy(by)
    w = whole.orderBy("pos")
    t = s.withColumn("top", F.max("score").over(whole)).withColumn("a", F.lag("score").over(w)).withColumn("b", F.lead("score").over(w))
    ok = (F.col("score") >= F.lit(share) * F.col("top")) & (F.col(
        "a").isNull() | (F.col("score") >= F.col("a"))) & (F.col("b").isNull() | (F.col("score") >= F.col("b")))
    first = F.min(F.when(ok, F.struct("pos", "i", "score")))
    best = F.max(F.struct("score", (-F.col("pos")).alias("k"), "i"))
    return t.groupBy(by).agg(first.alias("f"), best.alias("g")).select(
        by, F.coalesce("f.i", "g.i").alias("i"), F.coalesce("f.score", "g.score").alias("score"))


def depths(nodes: DataFrame) -> DataFrame:
    """(node, depth): steps from each node to base level."""
    down = F.when(F.col("recv") != F.col("node"), F.col("recv"))
    return along(nodes.select("node", "r", "c", "recv"), down, downs={"depth": down.isNotNull().cast("long")}).select("node", "depth")


def profiles(nodes: DataFrame, junctions: DataFrame, a0: float = 1000.0, m_over_n: float = 0.525, res: float = 1.0,
    min_nodes: int = 0) -> DataFrame:
    """(profile, i, node, z, chi, ncontrib, flc): from the hilltop of each junction (node, end) down to its end node.

    A profile of fewer than min_nodes nodes goes on below its end until it has as many, or to base level.
    All profiles are walked together by doubling, each as far as its own number of steps.
    """
    d = keep(depths(nodes), "depths")
    tops = keep(farthest_upslope(nodes, junctions), "tops").join(junctions.select(F.col("node").alias("top"), "end"), "top")
    high, low = d.select(F.col("node").alias("hilltop"), F.col("depth").alias("d1")), d.select(
        F.col("node").alias("end"), F.col("depth").alias("d2"))
    starts = tops.join(high, "hilltop").join(low, "end").select(
        F.col("top").alias("start"), F.col("hilltop").alias("node"),
        F.greatest(F.col("d1") - F.col("d2"), F.lit(min_nodes - 1)).cast("int").alias("most"))
    path = walk(steps_of(nodes), keep(starts, "starts")).select(F.col("start").alias("top"), "i", "node")
    t = path.join(nodes.select(F.col("node").alias("n4"), "z", "ncontrib", "flc"), F.col("node") == F.col("n4"))
    w = Window.partitionBy("top").orderBy("i")
    dx = F.when(F.col("flc") == 2, math.sqrt(2.0) * res).otherwise(res)
    term = F.when(F.lead("node").over(w).isNotNull(), dx * F.pow(F.lit(a0) / (F.col("ncontrib") * res * res), F.lit(m_over_n))).otherwise(0.0)
    return t.withColumn("_t", term).select(
        F.col("top").alias("profile"), "i", "node", "z",
        F.sum("_t").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("chi"), "ncontrib", "flc")


def single_precision_heads(
    p: DataFrame, least: int = 10, rule: str = "global", a0: float = 1000.0, m_over_n: float = 0.525,
    res: float = 1.0) -> DataFrame:
    """(profile, i, node): the split of each profile (from `profiles`) in 32-bit arithmetic, summed in order.

    Chi is summed from below, each step rounded to 32 bits. Rule global: the first best positive score;
    the head is the last node that stands as high. No positive score: no row. Rule uppermost: the first
    local maximum of at least 0.9 of the best (the hilltop of a profile too short to split).
    """
    if rule not in ("global", "uppermost"):
        raise ValueError("rule must be global or uppermost")

    def one(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("i").reset_index(drop=True)
        chi = chi32(pdf.ncontrib.to_numpy(), pdf.flc.to_numpy() == 2, a0, m_over_n, res)
        z = pdf.z.to_numpy(np.float32)
        n, splits = len(z), np.arange(least, len(z) - least + 1)
        score = scores32(chi, z, splits) if len(splits) else np.empty(0, np.float32)
        at = None
        if rule == "uppermost":
            at = 0
            if len(splits):
                rises = np.concatenate(([True], score[1:] >= score[:-1])) & np.concatenate((score[:-1] >= score[1:], [True]))
                good = np.flatnonzero(rises & (score >= np.float32(0.9) * score.max()))
                at = int(splits[good[0]] if len(good) else splits[score.argmax()])
        else:
            ok = np.where(score > 0, score, np.float32(0))
            if len(ok) and ok.max() > 0:
                at = int(np.flatnonzero(z == z[splits[ok.argmax()]])[-1])
        rows = [] if at is None else [(pdf.profile[0], at, pdf.node[at])]
        return pd.DataFrame(rows, columns=["profile", "i", "node"]).astype("int64")

    return p.select("profile", "i", "node", "z", "ncontrib", "flc").groupBy("profile").applyInPandas(one, "profile long, i long, node long")


def chi32(cells, diagonal, a0: float, m_over_n: float, res: float):
    """Chi from the last node up, every sum rounded to 32 bits."""
    import numpy as np

    f = np.float32
    dx = np.where(diagonal, f(np.sqrt(2.0) * res), f(res)).astype(float)
    share = (f(a0) / (cells.astype(f) * f(res * res))).astype(float)
    step = dx * share**m_over_n
    out = np.zeros(len(cells), f)
    for i in range(len(cells) - 2, -1, -1):
        out[i] = f(step[i] + float(out[i + 1]))
    return out


#: Numbers in a matrix of the 32-bit regressions.
MATRIX = 1 << 20


def scores32(x, y, splits):
    """As `_scores32`, the splits taken in blocks so that memory stays in proportion to the profile."""
    import numpy as np

    size = max(1, MATRIX // max(1, len(x)))
    return np.concatenate([_scores32(x, y, splits[k:k + size]) for k in range(0, len(splits), size)])


def _scores32(x, y, splits):
    """R2 of the part from each split down less (Durbin-Watson of the part above - 2) / 2, in 32 bits.

    Row k of a matrix holds the terms of one regression, zeros elsewhere, so that a cumulative sum along it
    adds them in the order of the profile.
    """
    import numpy as np

    f, place = np.float32, np.arange(len(x))
    total = lambda m: np.cumsum(m, axis=1, dtype=f)[:, -1]

    def regression(inside):
        only = lambda v: np.where(inside, v, f(0)).astype(f)
        n, sx, sy, sxx, sxy = inside.sum(axis=1).astype(f), total(only(x)), total(only(y)), total(only(x * x)), total(only(x * y))
        # two equations by elimination, the larger first coefficient as the pivot
        swap = np.abs(sx) > np.abs(sxx)
        p0, p1, pb = np.where(swap, sx, sxx), np.where(swap, n, sx), np.where(swap, sy, sxy)
        q0, q1, qb = np.where(swap, sxx, sx), np.where(swap, sx, n), np.where(swap, sxy, sy)
        times = (q0 / p0).astype(f)
        offset = ((qb - pb * times).astype(f) / (q1 - (times * p1).astype(f)).astype(f)).astype(f)
        slope = ((pb - (offset * p1).astype(f)).astype(f) / p0).astype(f)
        miss = ((slope[:, None] * x + offset[:, None]).astype(f) - y).astype(f)
        miss = np.where(np.abs(miss) < f(1e-12), f(0), miss)
        return n, sy, only(miss), only

    with np.errstate(divide="ignore", invalid="ignore"):
        n, sy, miss, only = regression(place >= splits[:, None])
        spread = total(only(((y - (sy / n).astype(f)[:, None]) ** 2).astype(f)))
        fit = (f(1) - total((miss * miss).astype(f)) / spread).astype(f)
        above = place < splits[:, None]
        _, _, miss, _ = regression(above)
        turns = np.where(above[:, 1:], np.diff(miss, axis=1).astype(f), f(0))
        rest = total((miss * miss).astype(f))
        watson = (total((turns * turns).astype(f)) / np.where(rest == 0, f(1e-10), rest)).astype(f)
        return (fit - ((watson - f(2)) / f(2)).astype(f)).astype(f)


def keep_uppermost(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """Heads without another head upstream; a head at base level goes."""
    at = nodes.join(heads.select("node").distinct(), "node", "left_semi").filter("recv <> node")
    below = downstream_of(nodes, at.select(F.col("recv").alias("node")))
    return at.select("node", "r", "c").join(below.select("node"), "node", "left_anti")


def stream_network(nodes: DataFrame, threshold: int) -> DataFrame:
    """(node, recv, ord, junction) of the channel cells: stream order, and whether a cell is a source, a confluence or a base level.

    A junction is known by its node; numbers for junctions would only be keys.
    """
    on = keep(nodes.filter(F.col("ncontrib") >= threshold).select("node", "recv"), "channel")
    seg = on.select((F.col("node") + 1).alias("cat"),
        F.when(F.col("recv") == F.col("node"), OUTLET).otherwise(F.col("recv") + 1).alias("tostream"))
    order = strahler(seg).select((F.col("cat") - 1).alias("n2"), "ord")
    fed = on.filter("recv <> node").groupBy(F.col("recv").alias("n3")).agg(F.count("*").alias("n"))
    t = on.join(order, F.col("node") == F.col("n2")).join(fed, F.col("node") == F.col("n3"), "left")
    return t.select("node", "recv", "ord", (F.coalesce("n", F.lit(0)) != 1).alias("fork"),
        (F.col("recv") == F.col("node")).alias("base")).select(
        "node", "recv", "ord", (F.col("fork") | F.col("base")).alias("junction"))


def upstream_junctions(net: DataFrame) -> DataFrame:
    """(node, junction): the first junction at or above each channel cell, along the one donor it has where it is none."""
    donor = net.filter("recv <> node").select(F.col("recv").alias("n2"), F.col("node").alias("up")).join(
        net.filter("NOT junction").select(F.col("node").alias("n3")), F.col("n2") == F.col("n3")).select("n2", "up")
    steps = net.select("node").join(donor, F.col("node") == F.col("n2"), "left").select("node", F.col("up").alias("to"))
    return nearest_below(steps, net.filter("junction")).select("node", F.col("at").alias("junction"))


def first_order_valleys(nodes: DataFrame, threshold: int) -> DataFrame:
    """(node, junction): every channel source is the head of a valley and its junction."""
    return sources(nodes, threshold).select("node", F.col("node").alias("junction"))


def valleys(nodes: DataFrame, gate: str, threshold: int, run: int = 10) -> DataFrame:
    """(node, junction): valleys found by walking down from each source through cells where `gate` holds.

    nodes has ncontrib, fd and the gate (null: no data). More than `run` gated cells in a row mark a
    valley; it is tagged at the last cell before the stream order next rises, with the first junction up
    from there. A walk ends where it marks, at missing data, and where another from a smaller source has gone on.

    So of the walks that come to a cell the one with the smallest source goes on, and what counts of it are its source
    and the gated cells behind it. Streams are taken order by order: when those of one order are done, all that flows
    into the next is known, and each stream (cells of one order, one after another) is a group of its own.
    """
    import pandas as pd

    net = keep(stream_network(nodes, threshold), "network")
    order = net.select(F.col("node").alias("n3"), F.col("ord").alias("o3"))
    more = nodes.select(F.col("node").alias("n2"), "fd", F.col(gate).cast("boolean").alias("gate"))
    there = keep(net.join(more, F.col("node") == F.col("n2")).join(order, F.col("recv") == F.col("n3")).select(
            "node", "recv", "ord", "fd", "gate", ((F.col("o3") != F.col("ord")) | (F.col("recv") == F.col("node"))).alias("last")), "gated")
    steps = there.select("node", F.when(~F.col("last"), F.col("recv")).alias("to"))
    mouth = nearest_below(steps, there.filter("last")).select(F.col("node").alias("n2"), F.col("at").alias("stream"))
    fed = there.filter("recv <> node").select(F.col("recv").alias("n3")).distinct()
    streams = keep(there.join(mouth, F.col("node") == F.col("n2")).join(fed, F.col("node") == F.col("n3"), "left").select(
            "node", "recv", "ord", "fd", "gate", "stream", F.col("n3").isNull().alias("source")), "streams")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fd", ascending=False)
        rows, walk_, behind = [], None, 0
        for node, is_source, open_, s, k in zip(pdf.node.tolist(), pdf.source.tolist(), pdf.gate.tolist(), pdf.s.tolist(), pdf.k.tolist()):
            if is_source:
                s, k = node, 0
            if s == s and s is not None and (walk_ is None or s < walk_):
                walk_, behind = s, int(k)
            if open_ is None or open_ != open_:
                walk_ = None
            if walk_ is None:
                continue
            behind = (behind + 1) * bool(open_)
            if behind > run:
                rows.append((node, None, None, None))
                walk_ = None
        if walk_ is not None:
            rows.append((None, pdf.recv.iloc[-1], walk_, behind))
        return pd.DataFrame(rows, columns=["mark", "to", "s", "k"]).astype({c: "Int64" for c in ("mark", "to", "s", "k")})

    told = keep(streams.limit(0).select(F.col("node").alias("mark"), F.col("node").alias("to"), F.col("node").alias("s"), F.col("node").alias("k")), "walks")
    parts = [told]
    for level in range(1, (net.agg(F.max("ord")).first()[0] or 0) + 1):
        come = together(parts).filter("to IS NOT NULL").groupBy(F.col("to").alias("n2")).agg(F.min(F.struct("s", "k")).alias("w"))
        met = streams.filter(F.col("ord") == level).join(come, F.col("node") == F.col("n2"), "left").select(
            "node", "recv", "fd", "gate", "stream", "source", F.col("w.s").alias("s"), F.col("w.k").alias("k"))
        parts.append(keep(met.groupBy("stream").applyInPandas(one, "mark long, to long, s long, k long"), "walks"))
    hits = together(parts).filter("mark IS NOT NULL").select(F.col("mark").alias("node"))
    up = net.select(F.col("node").alias("n3"), F.col("ord").alias("o3"))
    last = net.join(up, F.col("recv") == F.col("n3")).filter("o3 > ord").select("node")
    down = net.select("node", F.when(F.col("recv") != F.col("node"), F.col("recv")).alias("to"))
    ends = nearest_below(down, last).filter("at IS NOT NULL")
    tagged = hits.join(ends.select(F.col("node").alias("n4"), "at"), F.col("node") == F.col("n4")).select(F.col("at").alias("end")).distinct()
    return tagged.join(upstream_junctions(net), F.col("end") == F.col("node")).select(F.col("end").alias("node"), "junction")


def heads_from_valleys(
    nodes: DataFrame, found: DataFrame, threshold: int, least: int = 10, a0: float = 1000.0, m_over_n: float = 0.525,
    res: float = 1.0, min_profile_nodes: int = 0, extend_to_junction: bool = False, rule: str = "global",
    precision: int = 64) -> DataFrame:
    """(node, r, c): the head of each valley (node, junction), those with another head upstream left out.

    A profile runs from the hilltop to the junction; with extend_to_junction to the next junction below
    it (so heads below the source can be found), else to min_profile_nodes nodes at least. precision: 64,
    or 32 for the arithmetic of `single_precision_heads`.
    """
    if rule not in ("global", "uppermost"):
        raise ValueError("rule must be global or uppermost")
    ends = found.select(F.col("junction").alias("node")).distinct().withColumn("end", F.col("node"))
    if extend_to_junction:
        net = keep(stream_network(nodes, threshold), "network")
        steps = net.select("node", F.when(F.col("recv") != F.col("node"), F.col("recv")).alias("to"))
        below = nearest_below(steps, net.filter("junction")).select(F.col("node").alias("n2"), "at")
        first = net.select(F.col("node").alias("n3"), "recv")
        ends = ends.join(first, F.col("node") == F.col("n3")).join(below, F.col("recv") == F.col("n2"), "left").select(
            "node", F.coalesce("at", "end").alias("end"))
    p = keep(profiles(nodes, keep(ends, "ends"), a0, m_over_n, res, 0 if extend_to_junction else min_profile_nodes), "profiles")
    if precision == 32:
        picked = single_precision_heads(p, least, rule, a0, m_over_n, res).select("node")
    else:
        best = (chi_split if rule == "global" else uppermost_split)(p, least)
        picked = p.join(
            best.select(F.col("profile").alias("p2"), F.col("i").alias("i2")),
            (F.col("profile") == F.col("p2")) & (F.col("i") == F.col("i2"))).select("node")
    return keep_uppermost(nodes, keep(picked, "heads"))


def first_order_heads(
    nodes: DataFrame, threshold: int, least: int = 10, a0: float = 1000.0, m_over_n: float = 0.525,
    rule: str = "global", **more) -> DataFrame:
    """(node, r, c): heads of the first-order valleys, one sought in the profile of each channel source."""
    return heads_from_valleys(nodes, first_order_valleys(nodes, threshold), threshold, least, a0, m_over_n, rule=rule, **more)


def by_elevation(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, z, place) of heads (node) from the highest down, equal ones by node, places from 1."""
    z = nodes.select(F.col("node").alias("n2"), "z")
    at = heads.select("node").distinct().join(z, F.col("node") == F.col("n2")).select("node", "z")
    return prefix_sums(at, [F.desc("z"), F.col("node")], F.lit(1).cast("long"), "place")
