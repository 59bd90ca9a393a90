"""Numpy kernels over one group of rows (a tile, a raster, an edge), and the operators that run them.

`fill` is distributed: tiles are flooded on their own and exchange border values until nothing changes.
`fill_ordered` (one raster a task) also keeps the queue's order among equal heights. Evolution routes whole
rasters step after step, so a raster must fit a task: it is meant for small grids, many of them in parallel.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import drop, keep
from .routing import RING
from .tiles import TILE, dealt, grid_of
from .tiles import own as own_rows

STEPS = np.array([(dr, dc) for dr, dc, _ in RING])
LEVEL = np.array([w == 1.0 for *_, w in RING])
#: Fixed values of the incision solver: most Newton steps, and the change that ends them.
NEWTON_STEPS = 40
NEWTON_STOP = 1e-6
#: Fixed value: the share of a cell that a filled surface rises over along a diagonal.
DIAGONAL_RISE = 0.7071067811865476
#: Fixed value: from the median absolute deviation to a standard deviation.
MAD_SCALE = 0.6745


def _rows(grid: np.ndarray, r0: int, c0: int, name: str, **more) -> pd.DataFrame:
    r, c = np.nonzero(~np.isnan(grid))
    return pd.DataFrame({**more, "r": (r + r0).astype("int32"), "c": (c + c0).astype("int32"), name: grid[r, c].astype(float)})


def shifted(a: np.ndarray, k: int, missing) -> np.ndarray:
    """For each cell the value of its k-th neighbour."""
    wide = np.pad(a, 1, constant_values=missing)
    dr, dc = STEPS[k]
    return wide[1 + dr:wide.shape[0] - 1 + dr, 1 + dc:wide.shape[1] - 1 + dc]


# ---- filling


class Flood:
    """Waves of equal height, lowest first, over a padded flat grid.

    All cells of one height wait together in the order they came; a wave reaches every cell around it that
    none reached before, at once, the first of several waiting cells counting. Reached cells keep their
    own height if they stand above the wave, else they rise over it.
    """

    def __init__(self, z: np.ndarray, min_slope: float, cellsize: float):
        rows, cols = z.shape
        self.shape, wide = (rows, cols), cols + 2
        self.height = np.pad(z.astype(np.float32), 1, constant_values=np.nan).ravel()
        self.dry = ~np.isnan(self.height)  # cells that no wave has reached
        self.around = STEPS[:, 0] * wide + STEPS[:, 1]
        self.rise = np.where(LEVEL, np.float32(min_slope * cellsize), np.float32(min_slope * cellsize * DIAGONAL_RISE)).astype(np.float32)
        self.waiting: dict[float, list[np.ndarray]] = {}
        self.levels: list[float] = []

    def edge(self) -> np.ndarray:
        """Cells (padded flat) next to no data or to the outside, row by row."""
        at = np.flatnonzero(self.dry)
        return at[~self.dry[at[:, None] + self.around].all(axis=1)]

    def inside(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (r + 1) * (self.shape[1] + 2) + c + 1

    def wait(self, cells: np.ndarray) -> None:
        """Reached cells wait for the wave of their height, in the given order."""
        self.dry[cells] = False
        h = self.height[cells]
        for x in np.unique(h).tolist():
            if x not in self.waiting:
                self.waiting[x] = []
                heapq.heappush(self.levels, x)
            self.waiting[x].append(cells[h == np.float32(x)])

    def run(self) -> np.ndarray:
        while self.levels:
            level = heapq.heappop(self.levels)
            wave = self.waiting.pop(level)
            wave = wave[0] if len(wave) == 1 else np.concatenate(wave)
            met = (wave[:, None] + self.around).ravel()
            by = np.flatnonzero(self.dry[met])
            if not len(by):
                continue
            cells, first = np.unique(met[by], return_index=True)
            first = np.sort(first)
            cells, step = met[by[first]], by[first] % len(RING)
            low = self.height[cells] <= np.float32(level)
            self.height[cells[low]] = np.float32(level) + self.rise[step[low]]
            self.wait(cells)
        return self.height.reshape(self.shape[0] + 2, self.shape[1] + 2)[1:-1, 1:-1]


def flooded(z: np.ndarray, min_slope: float, cellsize: float) -> np.ndarray:
    """Depressions raised to their lowest pass, with a gradient towards it (NaN is no data)."""
    flood = Flood(z, min_slope, cellsize)
    flood.wait(flood.edge())
    return flood.run().copy()


def fill_ordered(cells: DataFrame, min_slope: float = 1e-4, cellsize: float = 1.0) -> DataFrame:
    """(raster_id, r, c, filled) with the queue's order among equal heights, a raster to a task."""
    def one(key, pdf):
        g, r0, c0 = grid_of(pdf.dropna(subset=["z"]), "z")
        return _rows(flooded(g, min_slope, cellsize), r0, c0, "filled", raster_id=key[0])

    return cells.select("raster_id", "r", "c", "z").groupBy("raster_id").applyInPandas(one, "raster_id long, r int, c int, filled double")


def fill(cells: DataFrame, min_slope: float = 0.0, cellsize: float = 1.0, tile: int = TILE, group: str | None = None) -> DataFrame:
    """(r, c, z, filled) of cells (r, c, z), by tiles; with group, each of its values is a raster of its own.

    A round floods every tile from the raster's open edge and from what is known of the cells around the
    tile. A cell's level depends on lower levels only, so rounds end; they grow with the tiles that a
    spill path crosses, not with its cells. Of equally low neighbours (in a flat) the one that the wave
    within the tile brings first counts, so with a gradient flats may rise by other steps than in
    `fill_ordered`; level fills are the same.
    """
    own = [group] if group else []
    kind = f"{group} {cells.schema[group].dataType.simpleString()}, " if group else ""
    schema = kind + "r int, c int, z double, f double, moved boolean"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = own_rows(pdf, tile)
        z, r0, c0 = grid_of(pdf, "z")
        flood = Flood(z, min_slope, cellsize)
        at = flood.inside(pdf.r.to_numpy() - r0, pdf.c.to_numpy() - c0)
        home = np.zeros(len(flood.height), bool)
        home[at[mine]] = True
        edge = flood.edge()
        flood.dry[at[~mine]] = False
        known = (~mine & pdf.f.notna()).to_numpy()
        flood.height[at[known]] = pdf.f.to_numpy()[known]
        flood.wait(np.sort(np.concatenate((edge[home[edge]], at[known]))))
        got = flood.run()
        out = pdf[mine]
        new = np.where(flood.dry[at[mine]], np.nan, got[out.r.to_numpy() - r0, out.c.to_numpy() - c0]).astype(float)
        old = out.f.to_numpy(float)
        moved = ~((new == old) | (np.isnan(new) & np.isnan(old)))
        return out[[*own, "r", "c", "z"]].assign(f=new, moved=moved)

    cur = keep(cells.filter("z IS NOT NULL").select(
            *own, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"),
            F.col("z").cast("double").alias("z"), F.lit(None).cast("double").alias("f")), "fill")
    while True:
        nxt = keep(dealt(cur, 1, tile).groupBy(*own, "tr", "tc").applyInPandas(one, schema), "fill")
        drop(cur)
        cur = nxt.drop("moved")
        if not nxt.filter("moved").limit(1).count():
            return cur.select(*own, "r", "c", "z", F.coalesce("f", "z").alias("filled"))


# ---- evolution


def route(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Receivers (flat), diagonal steps, contributing cells, and the nodes of each number of steps from base level."""
    ids = np.arange(z.size).reshape(z.shape)
    drops = np.stack([np.float32(w) * (z - shifted(z, k, np.nan)) for k, (*_, w) in enumerate(RING)])
    drops = np.where(np.isnan(drops), -np.inf, drops)
    best = drops.argmax(axis=0)
    falls = (drops.max(axis=0) > 0).ravel()
    to = (ids + STEPS[best, 0] * z.shape[1] + STEPS[best, 1]).ravel()
    recv = np.where(falls, to, ids.ravel())
    diagonal = falls & ~LEVEL[best].ravel()
    depth, jump = falls.astype(np.int64), recv.copy()
    while (step := depth[jump]).any():  # by doubling
        depth, jump = depth + step, jump[jump]
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth, minlength=1))[:-1])
    area = np.ones(z.size)
    for at in reversed(levels[1:]):
        np.add.at(area, recv[at], area[at])
    return recv, diagonal, area, levels


def lowered(drop_: np.ndarray, erosion: np.ndarray, n: float) -> np.ndarray:
    """The drop d that is left of each: d + erosion * d ** n = drop_, all of them solved together.

    Newton steps from above; one that leaves the interval known to hold the root (as with n under 1) halves it.
    """
    if n == 1.0:
        return drop_ / (1 + erosion)
    d, busy = drop_.copy(), np.flatnonzero(drop_ > 0)
    least, most = np.zeros_like(d), drop_.copy()
    for _ in range(NEWTON_STEPS):
        x, e = d[busy], erosion[busy]
        over = x + e * x**n - drop_[busy]
        most[busy], least[busy] = np.where(over > 0, x, most[busy]), np.where(over > 0, least[busy], x)
        new = x - over / (1 + n * e * x ** (n - 1))
        new = np.where((new > least[busy]) & (new <= most[busy]), new, (least[busy] + most[busy]) / 2)
        d[busy] = new
        busy = busy[np.abs(new - x) >= NEWTON_STOP]
        if not len(busy):
            break
    return d


def evolution(z: np.ndarray, k, m: float = 0.5, n: float = 1.0, uplift=1e-3, dt: float = 1000.0, cellsize: float = 1.0,
    fixed: np.ndarray | None = None, min_slope: float = 1e-4) -> Iterator[np.ndarray]:
    """The surface after each step of uplift and implicit stream-power incision, without end.

    Water is routed over the filled surface, the unfilled one is cut: nodes a step further from base level
    each time, so that receivers are done before their donors. k and uplift are numbers or grids; cells
    that are fixed neither rise nor are cut.
    """
    z = z.astype(float)
    data = ~np.isnan(z)
    still = (np.zeros_like(data) if fixed is None else fixed.astype(bool)) | ~data
    rising = np.where(still, 0.0, np.broadcast_to(np.asarray(uplift, float), z.shape) * dt)
    rate = np.broadcast_to(np.asarray(k, float), z.shape).ravel() * dt
    while True:
        z = z + rising
        recv, diagonal, area, levels = route(flooded(z, min_slope, cellsize))
        reach = np.where(diagonal, 2.0**0.5, 1.0) * cellsize
        erosion = rate * (area * cellsize * cellsize) ** m / reach**n
        flat = z.ravel()
        for at in levels[1:]:
            at = at[~still.ravel()[at]]
            base = flat[recv[at]]
            flat[at] = base + lowered(np.maximum(0.0, flat[at] - base), erosion[at], n)
        z = flat.reshape(z.shape)
        yield z


def edges_of(z: np.ndarray) -> np.ndarray:
    """The cells on the rim of the grid."""
    out = np.zeros(z.shape, bool)
    out[[0, -1], :] = out[:, [0, -1]] = True
    return out


def evolve(cells: DataFrame, steps: int = 100, boundary: str | None = "edges", record_every: int = 0, k: float = 1e-5, **settings) -> DataFrame:
    """(raster_id, step, r, c, z): the surface after the last step, or every record_every steps and the last.

    Optional columns k and uplift give rates for each cell, a boolean column fixed the boundary (boundary
    is "edges", "mask" for that column, or None). No steps: the cells as they are, as step -1.
    """
    if boundary not in ("edges", "mask", None) or boundary == "mask" and "fixed" not in cells.columns:
        raise ValueError("boundary must be edges, mask (with a column fixed) or None")
    own = [c for c in ("k", "uplift") if c in cells.columns]
    mask = ["fixed"] if boundary == "mask" else []

    def one(key, pdf):
        pdf = pdf.dropna(subset=["z"])
        g, r0, c0 = grid_of(pdf, "z")
        rates = {"k": k} | settings | {c: np.nan_to_num(grid_of(pdf, c)[0]) for c in own}
        fixed = edges_of(g) if boundary == "edges" else np.nan_to_num(
            grid_of(pdf.assign(fixed=pdf["fixed"].astype(float)), "fixed")[0]) > 0 if mask else None
        if not steps:
            return _rows(g.astype(np.float32), r0, c0, "z", raster_id=key[0], step=-1)
        kept = [(i, z) for i,
            z in zip(range(steps),
                evolution(g, fixed=fixed, **rates)) if i == steps - 1 or record_every and i % record_every == 0]
        return pd.concat(
            [_rows(z.astype(np.float32), r0, c0, "z", raster_id=key[0], step=i) for i, z in kept])[["raster_id", "step",
                "r", "c", "z"]]

    return cells.select("raster_id", "r", "c", "z", *own, *mask).groupBy("raster_id").applyInPandas(
        one, "raster_id long, step int, r int, c int, z double")


# ---- cleaning


def despike(y: np.ndarray, window: int = 2, k: float = 3.5) -> np.ndarray:
    """Inner points further than k robust deviations from their surroundings' median take the median of its sound points.

    Surroundings are rows of a sliding view. Where no point of them is sound, the median is of what stands
    there when the points are replaced from the first to the last.
    """
    y = np.asarray(y, float)
    n = len(y)
    if n < 3:
        return y.copy()
    near = np.lib.stride_tricks.sliding_window_view(np.pad(y, window, constant_values=np.nan), 2 * window + 1)
    there = np.lib.stride_tricks.sliding_window_view(np.pad(np.ones(n, bool), window), 2 * window + 1)
    gaps = (np.isnan(near) & there).any(axis=1)  # a missing value makes a median unknown
    middle = np.nanmedian(near[~gaps], axis=1) if (~gaps).any() else np.empty(0)
    bad = np.zeros(n, bool)
    spread = np.nanmedian(np.abs(near[~gaps] - middle[:, None]), axis=1) if len(middle) else middle
    with np.errstate(divide="ignore", invalid="ignore"):
        bad[~gaps] = (spread > 0) & (np.abs(MAD_SCALE * (y[~gaps] - middle) / spread) > k)
    bad[[0, -1]] = False
    ill = np.lib.stride_tricks.sliding_window_view(np.pad(bad, window, constant_values=True), 2 * window + 1)
    lost = bad & ill.all(axis=1)
    out, cure = y.copy(), np.flatnonzero(bad & ~lost)
    if len(cure):
        out[cure] = np.nanmedian(np.where(ill[cure], np.nan, near[cure]), axis=1)
    for i in np.flatnonzero(lost):
        out[i] = np.median(np.concatenate((out[max(0, i - window):i], y[i:i + window + 1])))
    return out


def diffuse(y: np.ndarray, left: float, right: float, alpha: float = 0.85, steps: int = 2000) -> np.ndarray:
    """Jacobi smoothing of an edge's values, whose first and last are replaced by the fixed ends; a single one by their mean."""
    y = np.asarray(y, float).copy()
    if len(y) == 1:
        return np.array([(left + right) / 2])
    if len(y):
        y[[0, -1]] = left, right
    for _ in range(steps if len(y) > 2 else 0):
        y[1:-1] += alpha * (0.5 * (y[:-2] + y[2:]) - y[1:-1])
    return y


def clean_edges(v: DataFrame, window: int = 100, k: float = 2.0, alpha: float = 0.85, steps: int = 2000, ends: DataFrame | None = None) -> DataFrame:
    """(cat, seq, z): each edge's values despiked and smoothed between its nodes' values.

    ends: (cat, left, right), the values of the nodes that an edge starts and ends at; without them, or where one is null,
    the edge's own first and last value.
    """
    def one(pdf):
        pdf = pdf.sort_values("seq")
        z = pdf.z.to_numpy(float)
        left, right = (z[i] if pdf[c].isna().iloc[0] else pdf[c].iloc[0] for i, c in ((0, "left"), (-1, "right")))
        return pdf[["cat", "seq"]].assign(z=diffuse(despike(z, window, k), left, right, alpha, steps))

    none = F.lit(None).cast("double")
    t = v.select("cat", "seq", "z")
    t = t.select("*", none.alias("left"), none.alias("right")) if ends is None else t.join(ends.select("cat", F.col("left").cast("double").alias("left"), F.col("right").cast("double").alias("right")), "cat", "left")
    return t.groupBy("cat").applyInPandas(one, "cat long, seq int, z double")
