"""Paths from cell to neighbouring cell, settled tile by tile: only cells on the rims of tiles are joined in rounds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import fixpoint, keep
from . import tiles


def _places(node: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The place of each `to` among the nodes; -1 where it isn't one of them or is the node itself."""
    by = np.argsort(node)
    at = by[np.minimum(np.searchsorted(node, to, sorter=by), len(node) - 1)]
    return np.where((node[at] == to) & (to != node), at, -1)


def _run(jump: np.ndarray, ups: list[np.ndarray], downs: list[np.ndarray]) -> np.ndarray:
    """The last place of each path by doubling; adds to ups and downs in place. Places in a circle keep a jump of 0 or more."""
    last = np.arange(len(jump))
    for _ in range(len(jump).bit_length() + 1):
        i = np.flatnonzero(jump >= 0)
        if not len(i):
            break
        j = jump[i]
        for u in ups:
            u += np.bincount(j, u[i], len(u)).astype(np.int64)
        for d in downs:
            d[i] += d[j]
        last[i], jump[i] = last[j], jump[j]
    return last


def along(cells: DataFrame, to: Column, ups: dict[str, Column] = {}, downs: dict[str, Column] = {},  # noqa: B006
    found: tuple[str, Column] | None = None) -> DataFrame:
    """cells (node, r, c, ...) with sums along the paths that lead from each cell to `to`, one of its eight neighbours, until that is null.

    ups: sums of a term over the cells whose paths come through the cell, itself included; downs: over the cell's own path;
    found: the value that the path's last cell has (null if it has none, or the path leads to a cell that isn't there). All whole numbers.

    A tile's paths are followed at once, in two passes over the cells; between them cells on the rims that are entered
    are joined by doubling, so what rounds write is a share of 4 / TILE of the cells. A circle raises ValueError.
    """
    tile, up, down = tiles.TILE, [f"_u{k}" for k in range(len(ups))], [f"_d{k}" for k in range(len(downs))]
    columns, has_value = cells.columns, found is not None
    whole = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    t = cells.select("*", F.floor(F.col("r") / tile).cast("int").alias("_tr"), F.floor(F.col("c") / tile).cast("int").alias("_tc"),
        F.coalesce(to, F.col("node")).cast("long").alias("_to"), *(whole(x).alias(n) for n, x in zip(up, ups.values())),
        *(whole(x).alias(n) for n, x in zip(down, downs.values())), (found[1] if has_value else F.lit(None)).cast("long").alias("_f"))

    def read(tab: pa.Table) -> tuple:
        node, to_ = (tab[x].to_numpy().astype(np.int64) for x in ("node", "_to"))
        return node, to_, _places(node, to_), *([tab[x].to_numpy().copy() for x in names] for names in (up, down))

    def first(tab: pa.Table) -> pa.Table:
        node, to_, jump, us, ds = read(tab)
        last = _run(jump, us, ds)
        leaves = (_places(node, to_) < 0) & (to_ != node)
        r, c = (tab[x].to_numpy() % tile for x in ("r", "c"))
        circle = jump >= 0
        # rim cells with where their paths leave the tile, then the sums that cross its border; of a circle one cell that jumps to itself
        rim = np.flatnonzero((r == 0) | (c == 0) | (r == tile - 1) | (c == tile - 1))
        cross = np.flatnonzero(leaves)
        if circle.any():
            rim = cross = np.flatnonzero(circle)[:1]
        end = last[rim]
        off = leaves[end] | circle[rim]
        n, m = len(rim), len(cross)
        both = lambda a, b: pa.array(np.concatenate((a, b)))
        none = np.zeros(n, np.int64), np.zeros(m, np.int64)
        cols = {"_tr": pa.array(np.full(n + m, tab["_tr"][0].as_py(), np.int32)), "_tc": pa.array(np.full(n + m, tab["_tc"][0].as_py(), np.int32)),
            "crosses": both(np.zeros(n, bool), np.ones(m, bool)), "node": both(node[rim], np.where(circle[cross], node[cross], to_[cross])),
            "jump": pa.array(np.concatenate((np.where(circle[rim], node[rim], to_[end]), none[1])), mask=np.concatenate((~off, np.ones(m, bool))))}
        cols |= {x: both(none[0], u[cross]) for x, u in zip(up, us)} | {x: both(d[rim], none[1]) for x, d in zip(down, ds)}
        f = tab["_f"].combine_chunks().take(pa.array(end))
        cols["_f"] = pa.concat_arrays([f if isinstance(f, pa.Array) else f.combine_chunks(), pa.nulls(m, pa.int64())])
        return pa.table(cols)

    sums = "".join(f", {x} long" for x in (*up, *down, "_f"))
    by = t.select("node", "r", "c", "_tr", "_tc", "_to", *up, *down, "_f").groupBy("_tr", "_tc")
    rims = keep(by.applyInArrow(first, f"_tr int, _tc int, crosses boolean, node long, jump long{sums}"), "rims")
    cross = rims.filter("crosses")
    come = cross.groupBy(F.col("node").alias("n2")).agg(F.count("*"), *(F.sum(x).alias(f"s{x}") for x in up))
    start = keep(rims.filter("NOT crosses").join(come, F.col("node") == F.col("n2")).select(
            "node", "jump", "_tr", "_tc", *(F.col(f"s{x}").alias(x) for x in up), *down, "_f"), "entered")

    def step(cur: DataFrame) -> DataFrame:
        live = cur.filter("jump IS NOT NULL")
        on = cur.select(F.col("node").alias("n2"), F.col("jump").alias("j2"), *(F.col(x).alias(f"o{x}") for x in down), F.col("_f").alias("f2"))
        moved = live.join(on, F.col("jump") == F.col("n2"), "left").select(
            "node", F.col("j2").alias("jump"), "_tr", "_tc", *up, *((F.col(x) + F.coalesce(f"o{x}", F.lit(0))).alias(x) for x in down), F.col("f2").alias("_f"))
        out = cur.filter("jump IS NULL").unionByName(moved)
        if not up:
            return out
        gain = live.groupBy(F.col("jump").alias("n3")).agg(*(F.sum(x).alias(f"g{x}") for x in up))
        return out.join(gain, F.col("node") == F.col("n3"), "left").select(
            "node", "jump", "_tr", "_tc", *((F.col(x) + F.coalesce(f"g{x}", F.lit(0))).alias(x) for x in up), *down, "_f")

    done = fixpoint(start, step, "jump IS NOT NULL", max(1, math.ceil(math.log2(max(2, start.count())))) + 1)
    # to each tile: what comes into its own cells, and what lies on from the cells its paths leave to
    known = done.select(F.col("node").alias("n2"), *down, "_f")
    out = cross.select("_tr", "_tc", "crosses", "node").distinct().join(known, F.col("node") == F.col("n2")).select(
        "_tr", "_tc", "crosses", "node", *(F.lit(0).cast("long").alias(x) for x in up), *down, "_f")
    told = out.unionByName(done.select("_tr", "_tc", F.lit(False).alias("crosses"), "node", *up, *down, "_f"))
    names = [*ups, *downs, *([found[0]] if has_value else [])]

    def second(tab: pa.Table, more: pa.Table) -> pa.Table:
        node, to_, jump, us, ds = read(tab)
        crosses = more["crosses"].to_numpy().astype(bool)
        there = more["node"].to_numpy()
        if len(there):
            at = np.argsort(node)
            at = at[np.searchsorted(node, there[~crosses], sorter=at)]
            for u, x in zip(us, up):
                u[at] += more[x].to_numpy()[~crosses]
        last = _run(jump, us, ds)
        after, f = to_[last], tab["_f"].combine_chunks().take(pa.array(last))
        left = np.flatnonzero((after != node[last]))
        value, valid = np.array(f.fill_null(0)), np.array(f.is_valid())
        valid[left] = False
        if crosses.any():
            out_ = np.flatnonzero(crosses)
            out_ = out_[np.argsort(there[out_])]
            k = out_[np.minimum(np.searchsorted(there[out_], after[left]), len(out_) - 1)]
            hit = there[k] == after[left]
            left, k = left[hit], k[hit]
            for d, x in zip(ds, down):
                d[left] += more[x].to_numpy()[k]
            g = more["_f"].combine_chunks().take(pa.array(k))
            value[left], valid[left] = np.array(g.fill_null(0)), np.array(g.is_valid())
        got = [*us, *ds] + ([pa.array(value, mask=~valid)] if has_value else [])
        return pa.Table.from_arrays([*(tab[x] for x in columns), *map(pa.array, got)], names=[*columns, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema] + [f"`{x}` long" for x in names])
    return t.groupBy("_tr", "_tc").cogroup(told.groupBy("_tr", "_tc")).applyInArrow(second, schema)
