"""Grids as cells (r, c, v): binary float grids with a text header, tiles, region arithmetic, point layers."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Region:
    west: float
    north: float
    ewres: float
    nsres: float
    rows: int
    cols: int

    @property
    def east(self) -> float:
        return self.west + self.cols * self.ewres

    @property
    def south(self) -> float:
        return self.north - self.rows * self.nsres

    @property
    def square(self) -> bool:
        return abs(self.ewres - self.nsres) <= 1e-6 * self.nsres


def header_of(text: str) -> tuple[Region, float | None, str]:
    """Region, no-data value and byte order that a grid's .hdr text tells."""
    got = {parts[0].lower(): parts[1] for parts in map(str.split, text.splitlines()) if len(parts) > 1}
    rows, cols, size = int(got["nrows"]), int(got["ncols"]), float(got["cellsize"])
    half = 0.5 * size if "xllcenter" in got else 0.0
    west, south = float(got.get("xllcorner", got.get("xllcenter", 0))) - half, float(got.get("yllcorner", got.get("yllcenter", 0))) - half
    missing = float(got["nodata_value"]) if "nodata_value" in got else None
    return Region(west, south + rows * size, size, size, rows, cols), missing, "<" if got.get(
        "byteorder", "lsbfirst").lower().startswith("l") else ">"


def read_flt(spark: SparkSession, path: str, header: str | None = None, window: tuple[int, int, int, int] | None = None) -> tuple[DataFrame, Region]:
    """Cells of a .flt grid (32-bit floats, rows from the north) of any size, or of a window of it; no-data cells are absent."""
    from .grid_source import read_grid

    return read_grid(spark, path, window, header=header or path.rsplit(".", 1)[0] + ".hdr", kind="f4")


def read_int(spark: SparkSession, path: str, header: str | None = None) -> tuple[DataFrame, Region]:
    """Cells (r, c, v int) of a grid of 32-bit integers, such as categories or directions; no-data cells are absent."""
    from .grid_source import read_grid

    cells, region = read_grid(spark, path, header=header or path.rsplit(".", 1)[0] + ".hdr", kind="i4")
    return cells.withColumn("v", F.col("v").cast("int")), region


def write_int(cells: DataFrame, path: str, value: str = "v", missing: int = -1) -> None:
    """Tiled integer cells for `read_window`, the given code (-1: a direction that nothing drains by) as no data."""
    write_cells(cells.filter(F.col(value) != missing).withColumn(value, F.col(value).cast("int")), path, value)


def cells_of(array: np.ndarray, spark: SparkSession, missing: float | None = None) -> DataFrame:
    """Cells (r, c, v) of an array in memory; NaN, infinities and the no-data value are absent."""
    grid = np.asarray(array, float)
    ok = np.isfinite(grid) if missing is None else np.isfinite(grid) & (grid != missing)
    r, c = np.nonzero(ok)
    return spark.createDataFrame(pa.table({"r": r.astype(np.int32), "c": c.astype(np.int32), "v": grid[r, c]}))


def warn_unless_square(region: Region) -> None:
    """Operators that take one cell size use the north-south one."""
    if not region.square:
        warnings.warn(f"cells are not square ({region.ewres} by {region.nsres}); {region.nsres} is used", stacklevel=2)


def write_cells(cells: DataFrame, path: str, value: str = "v", tile: int = 512) -> None:
    """Parquet partitioned by tile, NaN and infinities as absent values, so that windows prune partitions."""
    v = F.col(value)
    clean = cells.filter(v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v) < float("inf")))
    clean.withColumns({"tr": F.expr(f"r div {tile}"), "tc": F.expr(f"c div {tile}")}).repartition(
        "tr", "tc").write.mode("overwrite").partitionBy("tr", "tc").parquet(path)


def read_window(spark: SparkSession, path: str, r0: int, r1: int, c0: int, c1: int, tile: int = 512) -> DataFrame:
    """Cells of rows r0 to r1 and columns c0 to c1 (ends included); only their tiles are read."""
    t = spark.read.parquet(path).filter(F.col("tr").between(r0 // tile, r1 // tile) & F.col("tc").between(c0 // tile, c1 // tile))
    return t.filter(F.col("r").between(r0, r1) & F.col("c").between(c0, c1)).drop("tr", "tc")


def window_of(v: DataFrame, region: Region) -> tuple[int, int, int, int]:
    """Rows and columns that vertices (x, y) cover, one cell wider on each side and inside the region."""
    m = v.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    r = int((region.north - m.y1) // region.nsres) - 1, int((region.north - m.y0) // region.nsres) + 1
    c = int((m.x0 - region.west) // region.ewres) - 1, int((m.x1 - region.west) // region.ewres) + 1
    return max(0, r[0]), min(region.rows - 1, r[1]), max(0, c[0]), min(region.cols - 1, c[1])


def sample(points: DataFrame, cells: DataFrame, region: Region, value: str = "v") -> DataFrame:
    """Points with the value of the cell they lie in, null outside or without data."""
    from ..functions.scalar import cell_of

    r, c = cell_of(F.col("x"), F.col("y"), region.west, region.north, region.ewres, region.nsres, region.cols, region.rows)
    v = cells.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col(value))
    p = points.withColumn("_pr", r).withColumn("_pc", c)
    return p.join(v, (F.col("_pr") == F.col("_r")) & (F.col("_pc") == F.col("_c")), "left").drop("_pr", "_pc", "_r", "_c")


def cell_centres(cells: DataFrame, region: Region) -> DataFrame:
    """x, y of the middle of each cell."""
    return cells.withColumn("x", F.lit(region.west) + (F.col("c") + 0.5) * region.ewres).withColumn(
        "y", F.lit(region.north) - (F.col("r") + 0.5) * region.nsres)


def write_points(points: DataFrame, path: str, *columns: str) -> None:
    """Pipe-separated text with a header."""
    points.select(*columns).write.mode("overwrite").option("sep", "|").option("header", True).csv(path)
