import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_io_and_catalog import tiff
from thalweg.sources import grid_source as G
from thalweg.sources import raster as RA
from thalweg.sources import tiff as TF


def cells(df):
    return {(r.r, r.c): r.v for r in df.collect()}


def flt(tmp_path, grid, missing=-9999):
    (tmp_path / "a.flt").write_bytes(grid.astype("<f4").tobytes())
    (tmp_path / "a.hdr").write_text(f"ncols {grid.shape[1]}\nnrows {grid.shape[0]}\nxllcorner 0\nyllcorner 0\ncellsize 10\nNODATA_value {missing}\n")
    return str(tmp_path / "a.flt")


class Counted:
    """Ranged reads that are counted."""

    def __init__(self, monkeypatch):
        self.bytes = 0
        inner = G.Store.ranges

        def ranges(store, path=None):
            read = inner(store, path)

            def one(at, n):
                self.bytes += n
                return read(at, n)

            return one

        monkeypatch.setattr(G.Store, "ranges", ranges)


def test_many_tasks_to_a_raw_grid(spark, tmp_path, monkeypatch):
    grid = np.arange(700 * 19, dtype=float).reshape(700, 19)
    grid[5, 5], grid[6, 6] = -9999, np.nan
    at = flt(tmp_path, grid)
    df, region = G.read_grid(spark, at, taskCells=256 * 19)
    assert df.rdd.getNumPartitions() == 3 and (region.rows, region.cols) == (700, 19)
    assert cells(df) == {(r, c): grid[r, c] for r in range(700) for c in range(19) if (r, c) not in ((5, 5), (6, 6))}
    monkeypatch.setattr(G, "BAND_ROWS", 4)
    monkeypatch.setattr(G, "BAND_COLS", 8)
    reader = G.GridReader({"path": at, "window": "2,9,7,8"})  # bands narrower than the grid, read row by row
    got = {(r, c): v for p in reader.partitions() for b in reader.read(p) for r, c, v in zip(*(x.to_pylist() for x in b.columns))}
    assert got == {(r, c): grid[r, c] for r in range(2, 10) for c in (7, 8)}


@pytest.mark.parametrize("more", [{}, {"tile": 16}, {"tile": 16, "packed": True}])
def test_a_window_reads_only_its_blocks(spark, tmp_path, monkeypatch, more):
    grid = np.arange(100 * 90, dtype=np.float32).reshape(100, 90)
    (tmp_path / "g.tif").write_bytes(tiff(grid, **more))
    window = (20, 30, 34, 39)
    want = {(r, c): grid[r, c] for r in range(20, 31) for c in range(34, 40)}
    assert cells(TF.read_tiff(spark, str(tmp_path / "g.tif"), window)[0]) == want
    reader = G.GridReader({"path": str(tmp_path / "g.tif"), "window": "20,30,34,39"})
    count = Counted(monkeypatch)
    got = {(r, c): v for p in reader.partitions() for b in reader.read(p) for r, c, v in zip(*(x.to_pylist() for x in b.columns))}
    assert got == want
    blocks = 1 * 2 if more else 6  # of 16 x 16 cells, or strips of two rows
    assert count.bytes <= blocks * (16 * 16 if more else 180) * 4 + 200 and count.bytes < grid.nbytes / 8
    # blocks outside the window may be anything: their bytes aren't looked at
    data = bytearray((tmp_path / "g.tif").read_bytes())
    for b in reader.grid.blocks():
        if not (b.r <= 30 and b.r + b.rows > 20 and b.c < 40 and b.c + b.cols > 34):
            data[b.at:b.at + b.size] = b"\xff" * b.size
    (tmp_path / "h.tif").write_bytes(data)
    assert cells(TF.read_tiff(spark, str(tmp_path / "h.tif"), window)[0]) == want


def test_queries_of_one_frame_dont_narrow_each_other(spark, tmp_path):
    grid = np.arange(60, dtype=float).reshape(6, 10)
    df, _ = RA.read_flt(spark, flt(tmp_path, grid))
    assert cells(df.filter("r IN (1, 4) AND v > 15 AND c <> 3")) == {(r, c): grid[r, c] for r in (1, 4) for c in range(10) if grid[r, c] > 15 and c != 3}
    assert cells(df.filter("r = 9")) == {} and df.filter("r > 1 AND r < 2").count() == 0
    assert df.filter("r = 2 OR c = 2").count() == 15 and df.filter("r = 1").union(df.filter("r = 2")).count() == 20
    assert RA.read_flt(spark, str(tmp_path / "a.flt"), window=(-3, 1, 8, 99))[0].count() == 4
    assert RA.read_flt(spark, str(tmp_path / "a.flt"), window=(7, 9, 0, 1))[0].count() == 0


def test_files_with_64_bit_places(spark, tmp_path):
    grid = np.arange(24, dtype="<f4").reshape(4, 6)
    raw = zlib.compress(grid.tobytes())
    fields = [(256, 4, 1, 6), (257, 4, 1, 4), (258, 3, 1, 32), (259, 3, 1, 8), (273, 16, 1, 16), (277, 3, 1, 1), (278, 3, 1, 4), (279, 16, 1, len(raw)), (339, 3, 1, 3)]
    at = 16 + len(raw)
    data = b"II" + struct.pack("<HHHQ", 43, 8, 0, at) + raw + struct.pack("<Q", len(fields)) + b"".join(struct.pack("<HHQQ", *f) for f in fields) + b"\0" * 8
    (tmp_path / "b.tif").write_bytes(data)
    assert cells(TF.read_tiff(spark, str(tmp_path / "b.tif"))[0]) == {(r, c): grid[r, c] for r in range(4) for c in range(6)}


def test_tiles_are_written_read_and_replaced(spark, tmp_path):
    grid = np.arange(50 * 40, dtype=float).reshape(50, 40)
    region = RA.Region(5.0, 700.0, 10.0, 10.0, 50, 40)
    df = spark.createDataFrame([(r, c, float(grid[r, c])) for r in range(50) for c in range(40) if (r, c) != (3, 3)] + [(3, 3, float("nan"))], "r int, c int, v double")
    at = str(tmp_path / "tiles")
    G.write_grid(df.repartition(7), at, region, tile=16)
    back, found = G.read_grid(spark, at)
    assert found == region and cells(back) == {(r, c): grid[r, c] for r in range(50) for c in range(40) if (r, c) != (3, 3)}
    assert back.filter("r < 5 AND c < 5").count() == 24
    G.write_grid(df.filter("r < 20"), at, region, tile=16)
    assert G.read_grid(spark, at)[0].count() == 799
    assert len([p for p in (tmp_path / "tiles").iterdir() if p.is_dir()]) == 1
    tiles = json.loads((tmp_path / "tiles/grid.json").read_text())["tiles"]
    assert tiles == [[r, c] for r in range(2) for c in range(3)]


def test_a_failed_write_leaves_the_old_grid(spark, tmp_path):
    region, at = RA.Region(0.0, 40.0, 10.0, 10.0, 4, 4), str(tmp_path / "t")
    good = spark.range(16).select((F.col("id") / 4).cast("int").alias("r"), (F.col("id") % 4).cast("int").alias("c"), F.col("id").cast("double").alias("v"))
    G.write_grid(good, at, region, tile=2)
    for bad in (good.union(good.limit(1)), good.withColumn("r", F.col("r") + 1)):
        with pytest.raises(Exception):
            G.write_grid(bad, at, region, tile=2)
        assert G.read_grid(spark, at)[0].count() == 16 and len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 1
    with pytest.raises(Exception):
        good.write.format("grid").mode("append").options(region="{}", tile=2, missing=0, kind="<f4").save(at)
