"""Drainage-divide networks: edges on cell corners, crossings, segments and their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import keep, together
from .routing import gather
from .tiles import TILE


def edges(labels: DataFrame, ncols: int, stream: str | None = None) -> DataFrame:
    """(a, b): corner pairs between 4-neighbours with different labels; a corner is i * (ncols + 1) + j."""
    cols = ["lab"] + ([stream] if stream else [])
    g = gather(labels, cols, ((0, 1), (1, 0)))
    t = g.select("r", "c", "own", F.explode("near").alias("x")).filter("own.lab <> x.v.lab")
    if stream:
        t = t.filter(~F.col(f"own.{stream}") & ~F.col(f"x.v.{stream}"))
    w = ncols + 1
    right = F.col("x.k") == 0
    a = F.when(right, F.col("r") * w + F.col("c") + 1).otherwise((F.col("r") + 1) * w + F.col("c"))
    b = F.when(right, (F.col("r") + 1) * w + F.col("c") + 1).otherwise((F.col("r") + 1) * w + F.col("c") + 1)
    return t.select(a.cast("long").alias("a"), b.cast("long").alias("b"))


def decode_corner(df: DataFrame, corner: str, ncols: int) -> DataFrame:
    return df.withColumn("i", F.expr(f"{corner} div {ncols + 1}")).withColumn("j", F.col(corner) % (ncols + 1))


def diagonal_corners(nodes: DataFrame, ncols: int) -> DataFrame:
    """(corner, fx): corners that a diagonal step passes through, 1 for NW-SE and 2 for NE-SW."""
    dr, dc = F.expr(f"recv div {ncols}") - F.col("r"), F.col("recv") % ncols - F.col("c")
    t = nodes.withColumn("dr", dr).withColumn("dc", dc).filter("abs(dr) = 1 AND abs(dc) = 1")
    corner = (F.col("r") + (F.col("dr") > 0).cast("int")) * (ncols + 1) + F.col("c") + (F.col("dc") > 0).cast("int")
    # Of two flows through one corner the cell later in row order decides.
    return t.groupBy(corner.cast("long").alias("corner")).agg(
        F.max_by(F.when(F.col("dr") * F.col("dc") > 0, 1).otherwise(2), "node").alias("fx"))


def split_crossings(e: DataFrame, fx: DataFrame, ncols: int) -> DataFrame:
    """Edges over doubled corner ids: a crossing corner becomes two, one for each side of the flow line."""
    w = ncols + 1
    fa, fb = fx.select(F.col("corner").alias("a"), F.col("fx").alias("fa")), fx.select(F.col("corner").alias("b"), F.col("fx").alias("fb"))
    j = e.join(fa, "a", "left").join(fb, "b", "left")

    def half(here: str, other: str, f: str):
        up, down = F.expr(f"{other} div {w} < {here} div {w}"), F.expr(f"{other} div {w} > {here} div {w}")
        east = ~up & ~down & (F.col(other) > F.col(here))
        west = ~up & ~down & ~east
        first = F.when(F.col(f) == 1, up | east).otherwise(up | west)
        return F.when(F.col(f).isNull(), F.col(here) * 2).otherwise(F.col(here) * 2 + F.when(first, 0).otherwise(1))

    return j.select(half("a", "b", "fa").alias("a"), half("b", "a", "fb").alias("b"))


def corners(e: DataFrame) -> DataFrame:
    """(corner, degree)."""
    return e.select(F.explode(F.array("a", "b")).alias("corner")).groupBy("corner").agg(F.count("*").alias("degree"))


def _joined(pdf):
    """(id, comp): edges of one tile's pairs (x, y) with the least edge that pairs in the tile join them to."""
    import numpy as np
    import pandas as pd

    n = len(pdf)
    names, at = np.unique(np.concatenate([pdf["x"].to_numpy(), pdf["y"].to_numpy()]), return_inverse=True)
    x, y, lab = at[:n], at[n:], np.arange(len(names))
    while True:
        low = lab.copy()
        np.minimum.at(low, x, lab[y])
        np.minimum.at(low, y, lab[x])
        low = np.minimum(low, low[low])
        if (low == lab).all():
            return pd.DataFrame({"id": names, "comp": names[lab]})
        lab = low


def segments(e: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(seg, a, b): every edge with its segment, a maximal chain through corners of degree 2, named by its least edge.

    Chains are joined inside tiles of TILE x TILE corners, width being the corner ids in a row. Between tiles least labels
    spread along the pieces that an edge across a rim joins and jump to their own label, so rounds grow with the logarithm
    of the tiles a chain crosses and hold such pieces alone.
    """
    t = keep(e.select((F.least("a", "b") * F.lit(1 << 31) + F.greatest("a", "b")).alias("id")).distinct(), "edges")
    side = {"a": F.shiftright("id", 31), "b": F.col("id").bitwiseAND(F.lit((1 << 31) - 1))}
    tile = lambda c: F.struct(F.floor(c / (width * TILE)), F.floor(c % width / TILE))
    ends = t.select("id", F.explode(F.array(*side.values())).alias("corner"))
    through = ends.groupBy("corner").agg(F.count("*").alias("n"), F.min("id").alias("x"), F.max("id").alias("y")).filter("n = 2 AND x <> y")
    own = keep(through.select(tile(F.col("corner")).alias("tile"), "x", "y").groupBy("tile").applyInPandas(
            lambda pdf: _joined(pdf), "id long, comp long"), "pieces")
    met = own.filter(tile(side["a"]) != tile(side["b"])).groupBy("id").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y")
    met = keep(met.select("x", "y"), "met")
    pairs = keep(met.union(met.select("y", "x")).toDF("id", "other"), "pairs")
    cur = keep(pairs.select("id").distinct().select("id", F.col("id").alias("seg")), "seg")
    while True:
        near = pairs.join(cur.select(F.col("id").alias("other"), "seg"), "other").groupBy("id").agg(F.min("seg").alias("low"))
        best = cur.join(near, "id", "left").select("id", "seg", F.least("seg", "low").alias("low"))
        jump = cur.select(F.col("id").alias("low"), F.col("seg").alias("top"))
        new = keep(best.join(jump, "low").select("id", F.least("low", "top").alias("new"), "seg"), "seg")
        moved = bool(new.filter("new <> seg").limit(1).count())
        cur = new.select("id", F.col("new").alias("seg"))
        if not moved:
            break
    named = own.join(cur.select(F.col("id").alias("comp"), "seg"), "comp", "left").select("id", F.coalesce("seg", "comp").alias("seg"))
    # an edge in no pair is its own segment; no other one is named by a greater edge
    return named.union(t.select("id", "id")).groupBy("id").agg(F.min("seg").alias("seg")).select("seg", *(c.alias(k) for k, c in side.items()))


def segment_ends(seg: DataFrame, degree: DataFrame) -> DataFrame:
    """(seg, u, v, n): the end corners and number of steps of each segment; null ends for closed rings."""
    at = seg.select("seg", F.explode(F.array("a", "b")).alias("corner")).groupBy("seg", "corner").agg(
        F.count("*").alias("m")).join(degree, "corner")
    end = F.when((F.col("degree") != 2) | (F.col("m") == 1), F.col("corner"))
    one = at.groupBy("seg").agg(F.min(end).alias("u"), F.max(end).alias("v"))
    return one.join(seg.groupBy("seg").agg(F.count("*").alias("n")), "seg").select(
        "seg", F.when(F.col("u") != F.col("v"), F.col("u")).alias("u"),
        F.when(F.col("u") != F.col("v"), F.col("v")).alias("v"), "n")


def order(ends: DataFrame, degree: DataFrame, scheme: str = "topo", leaves: DataFrame | None = None) -> DataFrame:
    """(seg, ord, dd): order grown from the leaf segments inward, and the greatest distance from a leaf.

    Round by round a junction with one segment left without an order gives it one from those that have
    come in. Rings, and what no round reaches, stay 0. Leaves are segments with an end of degree 1
    unless given.
    """
    if scheme not in ("topo", "strahler", "shreve"):
        raise ValueError("scheme must be topo, strahler or shreve")
    t = ends.filter("u IS NOT NULL")
    if leaves is None:
        tips = degree.filter("degree = 1").select("corner")
        leaves = t.select("seg", F.explode(F.array("u", "v")).alias("corner")).join(tips, "corner", "left_semi").select("seg").distinct()
    done = keep(t.join(leaves.select("seg").distinct(), "seg", "left_semi").select(
            "seg", F.lit(1).cast("long").alias("ord"), F.col("n").cast("double").alias("dd")), "order")
    sides = keep(t.select("seg", "n", F.explode(F.array("u", "v")).alias("corner")), "sides")
    parts = [done]
    while True:
        done = together(parts)
        # segments of one order at a corner first, so that ties need no list of a corner's orders
        ranks = sides.join(done, "seg", "left").groupBy("corner", "ord").agg(F.count("*").alias("m"), F.max("seg").alias("seg"), F.max("dd").alias("dd"))
        known = F.col("ord").isNotNull()
        at = ranks.groupBy("corner").agg(
            F.coalesce(F.max(F.when(~known, F.col("m"))), F.lit(0)).alias("left"), F.count("ord").alias("have"), F.max(F.when(~known, F.col("seg"))).alias("seg"),
            F.max(F.when(known, F.struct("ord", "m"))).alias("top"), F.sum(F.col("ord") * F.col("m")).alias("total"), F.max("dd").alias("far"))
        top, shared = F.col("top.ord"), F.col("top.m") >= 2
        rule = {"topo": top + 1, "strahler": top + shared.cast("int"), "shreve": F.col("total")}[scheme]
        ready = at.filter("left = 1 AND have > 0").select("seg", rule.cast("long").alias("ord"), F.col("far").alias("dd"))
        new = ready.groupBy("seg").agg(F.min(F.struct("ord", "dd")).alias("b")).join(
            t.select("seg", "n"), "seg").select(
            "seg", F.col("b.ord").alias("ord"), (F.col("b.dd") + F.col("n")).alias("dd"))
        new = keep(new, "order")
        if not new.limit(1).count():
            break
        parts.append(new)
    return ends.select("seg").join(done, "seg", "left").select(
        "seg", F.coalesce("ord", F.lit(0)).cast("long").alias("ord"), F.coalesce("dd", F.lit(0.0)).alias("dd"))
