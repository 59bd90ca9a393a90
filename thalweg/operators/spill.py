"""Filling by a graph of passes: depressions of terrain of any size in rounds that grow with the logarithm of its pits.

Each tile is flooded from its rim alone, which gives its cells labels (the rim's low cells) and the lowest passes between
neighbouring labels, inside the tile and across tiles. Of the graph of labels and passes only the least spanning tree
matters: every component takes its lowest pass out, all at once, until all have come to the outside (Boruvka's rounds).
A label's level is the highest of the passes that its components have taken.

The tree is kept with its edges pointing to the outside: a component that joins another is turned to hang from the cell
of its pass. So each label has a cell that it spills from and a cell of the next label that it spills to. With a gradient a
cell stands at least a step above the one that the water of its label takes next. Along such ways heights are functions
max(c, g + w) of the height g of the label's spilling cell; they compose, and go down the tree by pointer doubling.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import drop, fixpoint, keep, walk
from .routing import RING
from .tiles import TILE, dealt, grid_of
from .tiles import own as own_rows

OUT = -1
DIAGONAL_RISE = 0.7071067811865476
STEPS = [(dr, dc, 1.0 if w == 1.0 else DIAGONAL_RISE) for dr, dc, w in RING]
PASS = "a long, b long, x long, y long, w double"


def _flooded(z: np.ndarray, seeds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Label (index of a seed, -1 for none) and height of each cell: the seed that it is reached from lowest, and how high."""
    rows, cols = z.shape
    label, height = np.full(z.shape, -1, np.int64), z.copy()
    heap = [(z[r, c], k, r, c, -1) for k, (r, c) in enumerate(seeds)]
    heapq.heapify(heap)
    count = len(heap)
    while heap:
        level, _, r, c, of = heapq.heappop(heap)
        if label[r, c] >= 0:
            continue
        label[r, c] = of = of if of >= 0 else r * cols + c
        height[r, c] = level
        for dr, dc, _ in STEPS:
            i, j = r + dr, c + dc
            if 0 <= i < rows and 0 <= j < cols and label[i, j] < 0 and z[i, j] == z[i, j]:
                count += 1
                heapq.heappush(heap, (max(level, z[i, j]), count, i, j, of))
    return label, height


def _labelled(cells: DataFrame, ncols: int, tile: int) -> DataFrame:
    """(r, c, z, node, label, f, open, rim): a label is the node of its lowest rim cell, f the height that the tile fills a cell to."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide, r0, c0 = grid_of(pdf, "z")
        near = np.pad(wide, 1, constant_values=np.nan)
        bare = np.zeros(wide.shape, bool)
        for dr, dc, _ in STEPS:
            bare |= np.isnan(near[1 + dr:near.shape[0] - 1 + dr, 1 + dc:near.shape[1] - 1 + dc])
        mine = pdf[own_rows(pdf, tile)].sort_values(["r", "c"])
        if not len(mine):  # a tile beside the terrain
            return mine[["r", "c", "z"]].assign(node=0, label=0, f=0.0, open=False, rim=False)
        z, r1, c1 = grid_of(mine, "z")
        r, c = mine.r.to_numpy(), mine.c.to_numpy()
        rim = (r % tile == 0) | (r % tile == tile - 1) | (c % tile == 0) | (c % tile == tile - 1)
        is_open = bare[r - r0, c - c0]
        seeds = [(int(i) - r1, int(j) - c1) for i, j in zip(r[rim | is_open], c[rim | is_open])]
        label, height = _flooded(z, seeds)
        at = label[r - r1, c - c1]
        node = (r.astype(np.int64)) * ncols + c
        name = (at // z.shape[1] + r1) * ncols + at % z.shape[1] + c1
        # cells that no rim and no edge reaches don't exist: a part of the terrain inside the tile has an edge of its own
        return mine[["r", "c", "z"]].assign(node=node, label=name, f=height[r - r1, c - c1], open=is_open, rim=rim)

    t = cells.filter("z IS NOT NULL").select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("z").cast("double").alias("z"))
    return dealt(t, 1, tile).groupBy("tr", "tc").applyInPandas(one, "r int, c int, z double, node long, label long, f double, open boolean, rim boolean")


def _passes(cells: DataFrame, ncols: int, tile: int) -> DataFrame:
    """PASS rows between labels a and b, each once in either direction: the lowest, from cell x of a to cell y of b."""

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        label, r0, c0 = grid_of(pdf, "label")
        f = grid_of(pdf, "f")[0]
        found = []
        for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
            rows, cols = label.shape
            a = slice(0, rows - dr), slice(max(0, -dc), cols - max(0, dc))
            b = slice(dr, rows), slice(max(0, dc), cols - max(0, -dc))
            with np.errstate(invalid="ignore"):
                i, j = np.nonzero((label[a] != label[b]) & ~np.isnan(label[a]) & ~np.isnan(label[b]))
            ar, ac, br, bc = i, j + a[1].start, i + dr, j + b[1].start
            found.append(pd.DataFrame({
                "a": label[ar, ac].astype(np.int64), "b": label[br, bc].astype(np.int64), "x": (ar + r0) * ncols + ac + c0, "y": (br + r0) * ncols + bc + c0, "w": np.maximum(f[ar, ac], f[br, bc])}))
        t = pd.concat(found, ignore_index=True)
        t = pd.concat([t, t.rename(columns={"a": "b", "b": "a", "x": "y", "y": "x"})[t.columns]], ignore_index=True)
        lo, hi = np.minimum(t.x, t.y), np.maximum(t.x, t.y)
        return t.assign(lo=lo, hi=hi).sort_values(["w", "lo", "hi"]).drop_duplicates(["a", "b"])[["a", "b", "x", "y", "w"]]

    place = [F.floor(F.col(k) / tile).alias(f"t{k}") for k in "rc"]
    own = cells.select("*", *place).groupBy("tr", "tc").applyInPandas(inside, PASS)
    rim = cells.filter("rim").select("r", "c", "node", "label", "f")
    around = F.explode(F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc, _ in STEPS)))
    sent = rim.select("r", "c", F.col("node").alias("x"), F.col("label").alias("a"), F.col("f").alias("fa"), around.alias("o")).select(
        "x", "a", "fa", (F.col("r") + F.col("o.dr")).alias("r2"), (F.col("c") + F.col("o.dc")).alias("c2"),
        F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc"))
    sent = sent.filter((F.floor(F.col("r2") / tile) != F.col("tr")) | (F.floor(F.col("c2") / tile) != F.col("tc")))
    met = sent.join(rim.select(F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("node").alias("y"), F.col("label").alias("b"), F.col("f").alias("fb")), ["r2", "c2"])
    across = met.select("a", "b", "x", "y", F.greatest("fa", "fb").alias("w"))
    out = cells.filter("open").select(F.col("label").alias("a"), F.lit(OUT).cast("long").alias("b"), F.col("node").alias("x"), F.lit(OUT).cast("long").alias("y"), F.col("f").alias("w"))
    return _lowest(own.unionByName(across).unionByName(out), "a", "b")


def _rank():
    """Passes in one order, the same from both sides."""
    return F.struct("w", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))


def _lowest(passes: DataFrame, *by: str) -> DataFrame:
    best = passes.groupBy(*by).agg(F.min_by(F.struct(*[c for c in passes.columns if c not in by]), _rank()).alias("p"))
    return best.select(*by, "p.*").select(passes.columns)


def spill_tree(passes: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, level, to, x, y): each label's level, the label that it spills to (OUT: the outside), and the cells on both sides.

    Labels that no way leads out of keep a null level and hang from one of their own.
    """
    comps = keep(labels.select("label", F.col("label").alias("comp"), F.lit(None).cast("double").alias("level")), "comps")
    tree = keep(labels.limit(0).select(F.col("label").alias("label"), F.col("label").alias("to"), F.col("label").alias("x"), F.col("label").alias("y")), "tree")
    edges = keep(passes.withColumnsRenamed({"a": "la", "b": "lb"}).select(F.col("la").alias("a"), F.col("lb").alias("b"), "la", "lb", "x", "y", "w"), "passes")
    while True:
        best = keep(_lowest(edges.filter(F.col("a") != OUT), "a"), "best")
        if not best.limit(1).count():
            return comps.join(tree, "label", "left").select("label", "level", F.coalesce("to", F.lit(OUT)).alias("to"), "x", "y")
        # of two components that take the same pass the smaller one waits
        other = best.select(F.col("a").alias("b"), F.col("b").alias("back"))
        hooks = keep(best.join(other, "b", "left").filter(F.col("back").isNull() | (F.col("back") != F.col("a")) | (F.col("a") > F.col("b"))).select("a", "b", "la", "lb", "x", "y", "w"), "hooks")
        # the component's tree is turned to hang from the label of its pass
        ways = tree.filter(F.col("to") != OUT).select(F.col("label").alias("node"), "to")
        path = keep(walk(ways, hooks.select(F.col("la").alias("start"))).select("start", "node"), "path")
        turned = path.join(tree, F.col("node") == F.col("label")).filter(F.col("to") != OUT).select(
            F.col("to").alias("label"), F.col("node").alias("to"), F.col("y").alias("x"), F.col("x").alias("y"))
        hung = hooks.select(F.col("la").alias("label"), F.col("lb").alias("to"), "x", "y")
        stays = tree.join(path.select(F.col("node").alias("label")).distinct(), "label", "left_anti")
        new_tree = keep(stays.unionByName(turned).unionByName(hung), "tree")

        # components go to the last one that their passes lead to
        def step(cur: DataFrame) -> DataFrame:
            on = cur.select(F.col("comp").alias("c2"), F.col("jump").alias("j2"), F.col("top").alias("t2"))
            moved = cur.filter("jump IS NOT NULL").join(on, F.col("jump") == F.col("c2"), "left").select("comp", F.col("j2").alias("jump"), F.coalesce("t2", "top").alias("top"))
            return cur.filter("jump IS NULL").unionByName(moved)

        tops = keep(fixpoint(hooks.select(F.col("a").alias("comp"), F.col("b").alias("jump"), F.col("b").alias("top")), step, "jump IS NOT NULL").select(F.col("comp").alias("c2"), "top"), "tops")
        rise = best.select(F.col("a").alias("c3"), "w")
        new_comps = keep(comps.join(tops, F.col("comp") == F.col("c2"), "left").join(rise, F.col("comp") == F.col("c3"), "left").select(
            "label", F.coalesce("top", "comp").alias("comp"), F.greatest("level", "w").alias("level")), "comps")
        ends = [tops.select(F.col("c2").alias(s), F.col("top").alias(f"{s}_top")) for s in "ab"]
        new_edges = edges.join(ends[0], "a", "left").join(ends[1], "b", "left").select(
            F.coalesce("a_top", "a").alias("a"), F.coalesce("b_top", "b").alias("b"), "la", "lb", "x", "y", "w").filter((F.col("a") != F.col("b")) & (F.col("a") != OUT))
        new_edges = keep(_lowest(new_edges, "a", "b"), "passes")
        for t in (comps, tree, edges):
            drop(t)
        comps, tree, edges = new_comps, new_tree, new_edges


def _ways(cells: DataFrame, tree: DataFrame, ncols: int, tile: int, slope: float) -> DataFrame:
    """(r, c, z, node, label, top, rise): a cell's height is the greater of top and its label's spilling height and rise."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"])
        z, r0, c0 = grid_of(pdf, "z")
        label = np.full(z.shape, -2, np.int64)
        label[pdf.r - r0, pdf.c - c0] = pdf["label"]
        top, rise, done = np.full(z.shape, -np.inf), np.zeros(z.shape), np.zeros(z.shape, bool)
        spill = pdf[pdf.node == pdf.x]
        heap = [(z[r, c], k, r, c, -np.inf, 0.0) for k, (r, c) in enumerate(zip((spill.r - r0).tolist(), (spill.c - c0).tolist()))]
        heapq.heapify(heap)
        count = len(heap)
        while heap:
            level, _, r, c, t, w = heapq.heappop(heap)
            if done[r, c]:
                continue
            done[r, c], top[r, c], rise[r, c] = True, t, w
            for dr, dc, share in STEPS:
                i, j = r + dr, c + dc
                if 0 <= i < z.shape[0] and 0 <= j < z.shape[1] and not done[i, j] and label[i, j] == label[r, c]:
                    count += 1
                    heapq.heappush(heap, (max(level, z[i, j]), count, i, j, max(z[i, j], t + slope * share), w + slope * share))
        at = pdf.r - r0, pdf.c - c0
        return pdf[["r", "c", "z", "node", "label"]].assign(top=top[at], rise=rise[at])

    t = cells.join(tree.select("label", "x"), "label").select(
        "r", "c", "z", "node", "label", "x", *[F.floor(F.col(k) / tile).alias(f"t{k}") for k in "rc"])
    return t.groupBy("tr", "tc").applyInPandas(one, "r int, c int, z double, node long, label long, top double, rise double")


def _spilling(ways: DataFrame, tree: DataFrame, ncols: int, slope: float) -> DataFrame:
    """(label, g): the height of the cell that each label spills from."""
    here = ways.select(F.col("node").alias("x"), F.col("z").alias("zx"))
    there = ways.select(F.col("node").alias("y"), F.col("top").alias("ty"), F.col("rise").alias("wy"))
    row, col = (lambda n: F.expr(f"{n} div {ncols}")), (lambda n: F.col(n) % ncols)
    slanting = (row("x") != row("y")) & (col("x") != col("y"))
    step = F.when(slanting, F.lit(slope * DIAGONAL_RISE)).otherwise(F.lit(float(slope)))
    start = tree.join(here, "x").join(there, "y", "left").select(
        "label", F.when(F.col("to") != OUT, F.col("to")).alias("jump"),
        F.when(F.col("to") == OUT, F.col("zx")).otherwise(F.greatest("zx", F.col("ty") + step)).alias("top"), F.when(F.col("to") != OUT, F.col("wy") + step).alias("rise"))

    def doubled(cur: DataFrame) -> DataFrame:
        on = cur.select(F.col("label").alias("l2"), F.col("jump").alias("j2"), F.col("top").alias("t2"), F.col("rise").alias("r2"))
        moved = cur.filter("jump IS NOT NULL").join(on, F.col("jump") == F.col("l2")).select(
            "label", F.col("j2").alias("jump"), F.greatest("top", F.col("t2") + F.col("rise")).alias("top"), (F.col("rise") + F.col("r2")).alias("rise"))
        return cur.filter("jump IS NULL").unionByName(moved)

    return fixpoint(start, doubled, "jump IS NOT NULL").select("label", F.col("top").alias("g"))


def fill_by_passes(cells: DataFrame, ncols: int, min_slope: float = 0.0, cellsize: float = 1.0, tile: int = TILE) -> DataFrame:
    """(r, c, z, filled): depressions raised to their lowest pass, and with min_slope every cell above the next one on its way out.

    Cells beside no data or the raster's end spill to the outside from their own height. A rise is min_slope times cellsize,
    0.707 of it along a diagonal. Without min_slope this is what `fill` gives; with it no cell is without a lower
    neighbour, but for those on the edge, and none is raised by more than the rises of its way out.
    """
    slope = float(min_slope * cellsize)
    t = keep(_labelled(cells, ncols, tile), "labelled")
    labels = t.select("label").distinct()
    tree = keep(spill_tree(keep(_passes(t, ncols, tile), "passes"), labels), "spills")
    if not slope:
        return t.join(tree.select("label", "level"), "label").select("r", "c", "z", F.greatest("f", "level").alias("filled"))
    ways = keep(_ways(t, tree, ncols, tile, slope), "ways")
    return ways.join(_spilling(ways, tree, ncols, slope), "label").select("r", "c", "z", F.greatest("top", F.col("g") + F.col("rise")).alias("filled"))
