"""Paths over tiles equal plain walks, and rounds write a share of the cells."""

import random

import pytest
from pyspark.sql import functions as F

from thalweg.operators import paths, routing, tiles


def wandering(rnd, rows, cols, first=-3):
    """{(r, c): receiver} without circles: a cell drains to a neighbour of smaller rank, some to none, some to a cell that isn't there."""
    cells = [(r, c) for r in range(first, first + rows) for c in range(cols) if rnd.random() < 0.93]
    rank = {x: r + c % 5 / 7 + rnd.random() * 2 for x in cells for r, c in [x]}
    out = {}
    for r, c in cells:
        near = [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if rank.get((r + a, c + b), 99) < rank[r, c]]
        out[r, c] = rnd.choice(near) if near and rnd.random() < 0.98 else (r, c)
    return out


@pytest.mark.parametrize("tile", [1, 4, 256])
def test_paths_equal_plain_walks(spark, monkeypatch, tile):
    monkeypatch.setattr(tiles, "TILE", tile)
    rnd = random.Random(tile)
    to = wandering(rnd, 30, 23)
    gone = rnd.choice([x for x in to if to[x] != x and sum(y == x for y in to.values()) > 1])
    del to[gone]  # what led there comes to an end without a value
    marks = {x: rnd.randrange(10**12, 10**13) for x in to if rnd.random() < 0.1}
    node = lambda x: x[0] * 100 + x[1]
    t = spark.createDataFrame([(f"t{node(x)}", node(x), *x, node(y), marks.get(x), 1 + node(x) % 3) for x, y in to.items()],
        "name string, node long, r int, c long, recv long, mark long, w int")
    down = F.when(F.col("mark").isNull() & (F.col("recv") != F.col("node")), F.col("recv"))
    got = paths.along(t, down, {"n": F.lit(1), "all": F.col("w")}, {"way": F.when(down.isNotNull(), F.col("w"))}, ("at", F.col("mark")))
    n, total, way, at = {}, {}, {}, {}
    for x in to:
        y, way[x] = x, 0
        while True:
            n[y], total[y] = n.get(y, 0) + 1, total.get(y, 0) + 1 + node(x) % 3
            if y in marks or to[y] == y:
                at[x] = marks.get(y)
                break
            way[x] += 1 + node(y) % 3
            y = to[y]
            if y not in to:
                at[x] = None
                break
    assert {(r.r, r.c): (r.name, r.n, r.all, r.way, r.at) for r in got.collect()} == {x: (f"t{node(x)}", n[x], total[x], way[x], at[x]) for x in to}


@pytest.mark.parametrize("tile", [2, 256])
def test_circles_raise(spark, monkeypatch, tile):
    monkeypatch.setattr(tiles, "TILE", tile)
    ring = [(r, c) for r, c in ((1, 1), (1, 2), (2, 2), (2, 1))]
    rows = [(r * 9 + c, r, c, a * 9 + b, 1) for (r, c), (a, b) in zip(ring, ring[1:] + ring[:1])] + [(0, 0, 0, 10, 1), (40, 4, 4, 40, 0)]
    with pytest.raises(routing.FlowLoop):
        routing.accumulate(spark.createDataFrame(rows, "node long, r int, c int, recv long, flc int"))


def test_rounds_write_cells_on_rims_alone(spark, monkeypatch):
    """Cells of a long path go to the shared folder in its rims, not in every round."""
    kept = []
    monkeypatch.setattr(paths, "keep", lambda df, name: kept.append(df.count()) or df)
    rows = [(r * 512 + c, r, c, min(r + 1, 511) * 512 + c, int(r < 511)) for r in range(512) for c in range(0, 512, 4)]
    t = spark.createDataFrame(rows, "node long, r int, c int, recv long, flc int")
    got = routing.accumulate(t)
    assert got.agg(F.max("ncontrib"), F.max("fd")).first()[:] == (512, 511.0) and max(kept) < len(rows) / 30
