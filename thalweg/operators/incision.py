"""Stream-power incision over a whole flow forest, and the evolution of terrain that takes many tasks.

An implicit step lowers a node by what its receiver becomes: with exponent 1, from height z and receiver y to
max(y, (z + e y) / (1 + e)), a rising, convex function of two pieces. Such functions compose. Inside a tile all
paths are followed at once; what a tile tells the others is, for the cells of its rim alone, the next tile's cell
that their path leads to and the composed function of that cell's height. These are composed by pointer doubling,
so rounds grow with the logarithm of the tiles that a path crosses. Pieces beyond the heights that the argument can
have (between its outlet's and the highest on its way there) are never made, so a function has one piece but for
paths that climb out of pits.

Other exponents have no such pieces: heights go from tile to tile then, a round for each that a path crosses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import drop, fixpoint, keep
from .kernels import fill, lowered
from .routing import accumulate, receivers
from .tiles import TILE

CELLS = "node long, r int, c int, z double, recv long, erosion double"


class Paths:
    """The paths inside one tile of its cells (node, recv): where they leave it, and their steps in order."""

    def __init__(self, pdf: pd.DataFrame):
        node, recv = pdf["node"].to_numpy(), pdf["recv"].to_numpy()
        at = np.searchsorted(node, recv)  # cells come sorted by node
        here = (at < len(node)) & (node[np.minimum(at, len(node) - 1)] == recv)
        self.leaves = ~here
        self.ends = here & (recv == node)
        self.to = np.where(here, at, np.arange(len(node)))
        jump, depth = self.to.copy(), (here & ~self.ends).astype(np.int64)
        while (step := depth[jump]).any():
            depth, jump = depth + step, jump[jump]
        self.last, self.depth = jump, depth

    def levels(self) -> Iterator[np.ndarray]:
        """Cells by their steps to the last one of the path, those from 1 step on."""
        order = np.argsort(self.depth, kind="stable")
        yield from np.split(order, np.cumsum(np.bincount(self.depth, minlength=1))[:-1])[1:]


class Pieces:
    """A rising piecewise linear function over [lo, hi]: a + b x between cuts."""

    def __init__(self, lo: float, hi: float, cuts, a, b):
        self.lo, self.hi, self.cuts, self.a, self.b = lo, hi, list(cuts), list(a), list(b)

    def spans(self) -> Iterator[tuple[float, float, float, float]]:
        ends = [self.lo, *self.cuts, self.hi]
        yield from zip(ends, ends[1:], self.a, self.b)

    def at(self, x: float) -> float:
        k = int(np.searchsorted(self.cuts, x))
        return self.a[k] + self.b[k] * x

    def under(self, outer: Pieces) -> Pieces:
        """outer of this function: this one's spans cut where its value passes a cut of the outer."""
        cuts, a, b = [], [], []
        for x0, x1, p, q in self.spans():
            k, stop = int(np.searchsorted(outer.cuts, p + q * x0)), int(np.searchsorted(outer.cuts, p + q * x1))
            for j in range(k, stop + 1):
                cuts.append(x0 if j == k else min(x1, max(x0, (outer.cuts[j - 1] - p) / q)))
                a.append(outer.a[j] + outer.b[j] * p)
                b.append(outer.b[j] * q)
        return Pieces(self.lo, self.hi, cuts[1:], a, b)


def step_of(z: float, erosion: float, top: float) -> Pieces:
    """A node's new height from its receiver's, up to `top`."""
    cut = [z] if top > z else []
    return Pieces(-np.inf, top, cut, [z / (1 + erosion), 0.0][:len(cut) + 1], [erosion / (1 + erosion), 1.0][:len(cut) + 1])


def _by_tile(cells: DataFrame, tile: int, one, schema: str) -> DataFrame:
    place = [F.floor(F.col(x) / tile).alias(f"t{x}") for x in ("r", "c")]
    return cells.select("*", *place).groupBy("tr", "tc").applyInPandas(lambda pdf: one(pdf.sort_values("node", ignore_index=True)), schema)


def _rim(pdf: pd.DataFrame, tile: int) -> np.ndarray:
    return (pdf.r % tile).isin((0, tile - 1)).to_numpy() | (pdf.c % tile).isin((0, tile - 1)).to_numpy()


def _bounds(cells: DataFrame, tile: int) -> DataFrame:
    """(node, lo, hi) of the rims' cells: the heights that a node's new one lies between."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p, z = Paths(pdf), pdf.z.to_numpy()
        top, jump = z.copy(), p.to.copy()
        for _ in range(int(p.depth.max()).bit_length()):
            top, jump = np.maximum(top, top[jump]), jump[jump]
        to = pdf.recv.where(p.leaves)[p.last].to_numpy()
        return pd.DataFrame({"node": pdf.node, "to": pd.array(to, "Int64"), "hi": top, "lo": np.where(p.leaves, np.nan, z)[p.last]})[_rim(pdf, tile)]

    def step(cur: DataFrame) -> DataFrame:
        on = cur.select(F.col("node").alias("n2"), F.col("to").alias("t2"), F.col("hi").alias("h2"), F.col("lo").alias("l2"))
        moved = cur.filter("to IS NOT NULL").join(on, F.col("to") == F.col("n2")).select("node", F.col("t2").alias("to"), F.greatest("hi", "h2").alias("hi"), F.col("l2").alias("lo"))
        return cur.filter("to IS NULL").unionByName(moved)

    return fixpoint(_by_tile(cells, tile, one, "node long, to long, hi double, lo double"), step, "to IS NOT NULL").select("node", "lo", "hi")


def _met(cells: DataFrame, rim: DataFrame, tile: int, names: list[str]) -> DataFrame:
    """The cells with columns of the rim's cell that they drain to in another tile, null elsewhere."""
    across = F.lit(False)
    other = rim.select(F.col("node").alias("_n"), *names)
    for x, y in (("r", F.expr("recv div _cols")), ("c", F.expr("recv % _cols"))):
        across = across | (F.floor(F.col(x) / tile) != F.floor(y / tile))
    key = F.when(across, F.col("recv")).otherwise(-1 - F.col("node"))  # a key that nothing has, and of its own, where it stays inside
    return cells.withColumn("_key", key).join(other, F.col("_key") == F.col("_n"), "left").drop("_key", "_n")


FUNCTION = "node long, to long, lo double, hi double, cuts array<double>, a array<double>, b array<double>"


def _functions(cells: DataFrame, tile: int) -> DataFrame:
    """FUNCTION rows of the rims' cells: the new height from that of the cell `to` of the next tile (null: a is the height)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p, z, e = Paths(pdf), pdf.z.to_numpy(), pdf.erosion.to_numpy()
        lo, hi = pdf.lo.to_numpy()[p.last], pdf.hi.to_numpy()[p.last]  # of the argument, NaN where the path ends here
        ends = ~p.leaves[p.last]
        lo, hi = np.where(ends, 0.0, lo), np.where(ends, 0.0, hi)
        # the argument is the height of the cell that the last one drains to; a path's end has its own height whatever the argument
        a, b = np.where(ends, z, 0.0), np.where(ends, 0.0, 1.0)
        many: dict[int, Pieces] = {}

        def apply(at: np.ndarray, from_: np.ndarray) -> None:
            """The step of each cell after the function so far of the cells from_."""
            low, high = a[from_] + b[from_] * lo[at], a[from_] + b[from_] * hi[at]
            falls, stays = high <= z[at], low >= z[at]
            grows = np.array([i in many for i in from_.tolist()]) if many else np.zeros(len(at), bool)
            split = grows | ~(falls | stays)
            q = e[at] / (1 + e[at])
            new_a, new_b = np.where(falls, z[at] / (1 + e[at]) + q * a[from_], a[from_]), np.where(falls, q * b[from_], b[from_])
            found = {i: many.get(j, Pieces(lo[i], hi[i], [], [a[j]], [b[j]])).under(step_of(z[i], e[i], np.inf)) for i, j in zip(at[split].tolist(), from_[split].tolist())}
            a[at[~split]], b[at[~split]] = new_a[~split], new_b[~split]
            for i, f in found.items():
                if len(f.a) > 1:
                    many[i] = f
                else:
                    a[i], b[i] = f.a[0], f.b[0]

        first = np.flatnonzero(p.leaves)
        apply(first, first)
        for at in p.levels():
            apply(at, p.to[at])
        rim = np.flatnonzero(_rim(pdf, tile))
        fs = [many.get(i, Pieces(lo[i], hi[i], [], [a[i]], [b[i]])) for i in rim.tolist()]
        to = pdf.recv.where(p.leaves)[p.last].to_numpy()[rim]
        return pd.DataFrame({"node": pdf.node.to_numpy()[rim], "to": pd.array(to, "Int64"), "lo": lo[rim], "hi": hi[rim], "cuts": [f.cuts for f in fs], "a": [f.a for f in fs], "b": [f.b for f in fs]})

    return _by_tile(cells, tile, one, FUNCTION)


def _composed(functions: DataFrame) -> DataFrame:
    """(node, y): the new heights of the rims' cells, by composing the functions along the paths, twice as far each round."""

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b.itertuples():
                f = Pieces(x.lo2, x.hi2, x.cuts2, x.a2, x.b2).under(Pieces(x.lo, x.hi, x.cuts, x.a, x.b))
                out.append((x.node, x.to2, x.lo2, x.hi2, f.cuts, f.a, f.b))
            got = pd.DataFrame(out, columns=["node", "to", "lo", "hi", "cuts", "a", "b"])
            yield got.assign(to=pd.array(got["to"].where(got["to"].notna(), None), "Int64"))

    def step(cur: DataFrame) -> DataFrame:
        on = cur.select(*[F.col(x).alias(f"{x}2") for x in cur.columns])
        met = cur.filter("to IS NOT NULL").join(on, F.col("to") == F.col("node2"))
        return cur.filter("to IS NULL").unionByName(met.mapInPandas(compose, FUNCTION))

    return fixpoint(functions, step, "to IS NOT NULL").select("node", (F.get("a", F.lit(0)) + F.get("b", F.lit(0)) * F.col("lo")).alias("y"))


def _settled(cells: DataFrame, tile: int, n: float) -> DataFrame:
    """(node, r, c, z) of the cells whose receiver beyond the tile has its height y, tile by tile; null where it is unknown."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p, z, e = Paths(pdf), pdf.z.to_numpy(float).copy(), pdf.erosion.to_numpy()
        first = np.flatnonzero(p.leaves)
        for at, base in [(first, pdf.y.to_numpy(float)[first]), *((at, None) for at in p.levels())]:
            base = z[p.to[at]] if base is None else base
            drop_ = np.maximum(0.0, z[at] - base)
            known = ~np.isnan(base)
            z[at] = np.nan
            z[at[known]] = base[known] + lowered(drop_[known], e[at][known], n)
        return pdf[["node", "r", "c"]].assign(z=z)

    return _by_tile(cells, tile, one, "node long, r int, c int, z double")


def incise(nodes: DataFrame, ncols: int, n: float = 1.0, tile: int = TILE) -> DataFrame:
    """(node, r, c, z): heights after one implicit step of cells (node, r, c, z, recv, erosion); a cell that receives itself stays.

    erosion is rate * dt * area ^ m / reach ^ n of each cell, 0 or more; null or 0 leaves max(z, the receiver's).
    """
    cells = keep(nodes.select(
        "node", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("z").cast("double").alias("z"), "recv",
        F.coalesce("erosion", F.lit(0.0)).alias("erosion"), F.lit(ncols).cast("long").alias("_cols")), "cells")
    if n == 1.0:
        bounds = _bounds(cells, tile)
        rim = _composed(_functions(_met(cells, bounds, tile, ["lo", "hi"]), tile))
        out = keep(_settled(_met(cells, rim, tile, ["y"]), tile, n), "incised")
    else:
        rim = cells.limit(0).select("node", F.col("z").alias("y"))
        left = None
        while left != 0:
            out = keep(_settled(_met(cells, rim, tile, ["y"]), tile, n), "incised")
            left, before = out.filter("z IS NULL").count(), left
            if left and left == before:
                raise ValueError("flow directions contain a loop")
            if left:
                at_rim = F.lit(False)
                for x in ("r", "c"):
                    at_rim = at_rim | (F.col(x) % tile).isin(0, tile - 1)
                rim = out.filter(at_rim & F.col("z").isNotNull()).select("node", F.col("z").alias("y"))
    drop(cells)
    return out


def _value(given, cells: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0)) if name in cells.columns else F.lit(float(given))


def evolve_tiled(cells: DataFrame, steps: int, ncols: int, k: float = 1e-5, m: float = 0.5, n: float = 1.0, uplift: float = 1e-3, dt: float = 1000.0,
    cellsize: float = 1.0, min_slope: float = 1e-4, boundary: str | None = "edges", tile: int = TILE) -> DataFrame:
    """(r, c, z) of one raster of any size after steps of uplift and incision; columns k and uplift give rates for each cell.

    Water is routed over the filled surface, the unfilled one is cut. boundary: edges (the raster's first and last rows
    and columns), mask (a boolean column fixed) or None; fixed cells neither rise nor are cut.
    """
    if boundary not in ("edges", "mask", None) or boundary == "mask" and "fixed" not in cells.columns:
        raise ValueError("boundary must be edges, mask (with a column fixed) or None")
    ends = cells.filter("z IS NOT NULL").agg(*[f(x).alias(f"{g}_{x}") for x in ("r", "c") for g, f in (("lo", F.min), ("hi", F.max))])
    t = cells.filter("z IS NOT NULL").crossJoin(F.broadcast(ends))  # one row
    rim = F.lit(False)
    for x in ("r", "c"):
        rim = rim | (F.col(x) == F.col(f"lo_{x}")) | (F.col(x) == F.col(f"hi_{x}"))
    still = rim if boundary == "edges" else F.coalesce(F.col("fixed"), F.lit(False)) if boundary == "mask" else F.lit(False)
    rates = keep(t.select("r", "c", F.col("z").cast("double").alias("z"), still.alias("still"), _value(k, cells, "k").alias("k"), _value(uplift, cells, "uplift").alias("u")), "rates")
    cur = rates.select("r", "c", "z")
    fixed = rates.drop("z")
    for _ in range(steps):
        risen = keep(cur.join(fixed, ["r", "c"]).select("r", "c", "still", "k", (F.col("z") + F.when(F.col("still"), 0.0).otherwise(F.col("u") * dt)).alias("z")), "risen")
        surface = fill(risen, min_slope, cellsize, tile).select("r", "c", F.col("filled").alias("z"))
        flow = accumulate(keep(receivers(surface, ncols), "nodes"), cellsize).select("node", "r", "c", "recv", "flc", "ncontrib")
        reach = F.when(F.col("flc") == 2, F.lit(2.0**0.5 * cellsize)).otherwise(F.lit(float(cellsize)))
        erosion = F.col("k") * dt * F.pow(F.col("ncontrib") * F.lit(float(cellsize) ** 2), F.lit(m)) / F.pow(reach, F.lit(n))
        held = F.col("still")  # a fixed cell is the end of the paths that come to it
        nodes = flow.join(risen, ["r", "c"]).select(
            "node", "r", "c", "z", F.when(held, F.col("node")).otherwise(F.col("recv")).alias("recv"), erosion.alias("erosion"))
        cur = incise(nodes, ncols, n, tile).select("r", "c", "z")
    return cur
