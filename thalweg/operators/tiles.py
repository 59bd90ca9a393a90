"""Grids dealt into square tiles with a rim of their neighbours' cells, for stencils that numpy does in one go."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells on a side of a tile.
TILE = 256


def dealt(cells: DataFrame, halo: int, tile: int = TILE) -> DataFrame:
    """Cells (r, c, ...) with their tile (tr, tc), once more for every other tile that lies within `halo` cells."""
    def touched(x: str):
        near = lambda k: F.floor((F.col(x) + k) / tile).cast("int")
        return F.explode(F.sequence(near(-halo), near(halo)))

    return cells.select("*", touched("r").alias("tr")).select("*", touched("c").alias("tc"))


def own(pdf: pd.DataFrame, tile: int = TILE) -> np.ndarray:
    """Which rows of a dealt tile are its own, not the rim's."""
    return ((pdf.r // tile == pdf.tr) & (pdf.c // tile == pdf.tc)).to_numpy()


def grid_of(pdf: pd.DataFrame, value: str) -> tuple[np.ndarray, int, int]:
    """An array of the rows' values, NaN where there are none, and its first row and column."""
    r0, c0 = int(pdf.r.min()), int(pdf.c.min())
    grid = np.full((int(pdf.r.max()) - r0 + 1, int(pdf.c.max()) - c0 + 1), np.nan)
    grid[pdf.r - r0, pdf.c - c0] = pdf[value]
    return grid, r0, c0


def stencil(cells: DataFrame, value: str, halo: int, compute: Callable[[np.ndarray], np.ndarray], name: str, tile: int = TILE) -> DataFrame:
    """(r, c, name): compute over the grid of each tile and its rim, for the cells of the tile; NaN gives null."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, r0, c0 = grid_of(pdf, value)
        mine = pdf[own(pdf, tile)]
        found = compute(grid)[mine.r.to_numpy() - r0, mine.c.to_numpy() - c0]
        return mine[["r", "c"]].assign(**{name: np.where(np.isnan(found), None, found)})

    rows = cells.filter(F.col(value).isNotNull()).select(
        F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col(value).cast("double").alias(value))
    return dealt(rows, halo, tile).groupBy("tr", "tc").applyInPandas(one, f"r int, c int, {name} double")


def windows(grid: np.ndarray, k: int) -> Callable[[int, int], np.ndarray]:
    """place (dr, dc) -> the grid moved so that each cell shows the one that far from it, NaN beyond the edge."""
    wide = np.pad(grid, k, constant_values=np.nan)
    return lambda dr, dc: wide[k + dr:wide.shape[0] - k + dr, k + dc:wide.shape[1] - k + dc]
