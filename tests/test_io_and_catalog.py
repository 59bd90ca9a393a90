import json
import os
import struct
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg import catalog
from thalweg.operators import evaluate as E
from thalweg.sources import network as NW
from thalweg.sources import raster as RA
from thalweg.sources import tiff as TF

SF = "/root/testdata/sf0.001"


def test_float_grid_and_tiles(spark, tmp_path):
    grid = np.arange(12, dtype="<f4").reshape(3, 4)
    grid[1, 1] = -9999
    (tmp_path / "a.flt").write_bytes(grid.tobytes())
    (tmp_path / "a.hdr").write_text("ncols 4\nnrows 3\nxllcorner 0\nyllcorner 0\ncellsize 10\nNODATA_value -9999\nbyteorder LSBFIRST\n")
    cells, region = RA.read_flt(spark, str(tmp_path / "a.flt"))
    assert cells.count() == 11 and (region.north, region.east, region.square) == (30, 40, True)
    pts = spark.createDataFrame([(0, 5.0, 25.0), (1, 39.0, 1.0), (2, 15.0, 15.0), (3, 40.0, 12.0), (4, 35.0, 0.0), (5, 40.001, 12.0)], "id long, x double, y double")
    got = {r.id: r.v for r in RA.sample(pts, cells, region).collect()}
    assert got == {0: 0.0, 1: 11.0, 2: None, 3: 7.0, 4: 11.0, 5: None}
    RA.write_cells(cells.union(spark.createDataFrame([(9, 9, float("nan"))], cells.schema)), str(tmp_path / "t"), tile=2)
    assert sorted(r.v for r in RA.read_window(spark, str(tmp_path / "t"), 0, 1, 2, 3, tile=2).collect()) == [2, 3, 6, 7]
    assert RA.window_of(pts.filter("id < 2"), region) == (0, 2, 0, 3)


def tiff(grid, order="<", tile=None, packed=False, predictor=1):
    """A file as writers make them: blocks first, then the fields."""
    rows, cols = grid.shape
    kind = grid.dtype.newbyteorder(order)
    if tile:
        blocks = [np.pad(grid[r:r + tile, c:c + tile], ((0, max(0, r + tile - rows)), (0, max(0, c + tile - cols)))) for r in range(0, rows, tile) for c in range(0, cols, tile)]
    else:
        blocks = [grid[r:r + 2] for r in range(0, rows, 2)]
    if predictor == 2:
        blocks = [np.concatenate((b[:, :1], np.diff(b, axis=1)), axis=1) for b in blocks]
    raw = [b.astype(kind).tobytes() for b in blocks]
    raw = [zlib.compress(x) for x in raw] if packed else raw
    data, places = bytearray(b"\0" * 8), []
    for x in raw:
        places.append(len(data))
        data += x
    fields = [(256, "H", [cols]), (257, "H", [rows]), (258, "H", [grid.dtype.itemsize * 8]), (259, "H", [8 if packed else 1]), (277, "H", [1]), (317, "H", [predictor]), (339, "H", [{"u": 1, "i": 2, "f": 3}[grid.dtype.kind]])]
    fields += [(322, "H", [tile]), (323, "H", [tile]), (324, "I", places), (325, "I", list(map(len, raw)))] if tile else [(273, "I", places), (278, "H", [2]), (279, "I", list(map(len, raw)))]
    fields += [(33550, "d", [10.0, 10.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 500.0, 900.0, 0.0]), (42113, "s", b"-9999\0")]
    entries = b""
    for tag, letter, values in sorted(fields):
        body = values if letter == "s" else struct.pack(f"{order}{len(values)}{letter}", *values)
        if len(body) > 4:
            at = len(data)
            data += body
            body = struct.pack(f"{order}I", at)
        entries += struct.pack(f"{order}HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[letter], len(values)) + body.ljust(4, b"\0")
    at = len(data)
    data += struct.pack(f"{order}H", len(fields)) + entries + b"\0" * 4
    data[:8] = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, at)
    return bytes(data)


def test_tiff_grids(spark, tmp_path):
    grid = np.arange(35, dtype=np.float32).reshape(5, 7)
    grid[2, 3] = -9999
    for k, (g, more) in enumerate([(grid, {}), (grid, {"order": ">", "packed": True}), (grid.astype(np.int32), {"tile": 16, "packed": True, "predictor": 2}), (grid.astype(np.int16), {"tile": 4})]):
        (tmp_path / f"{k}.tif").write_bytes(tiff(g, **more))
        cells, region = TF.read_tiff(spark, str(tmp_path / f"{k}.tif"))
        assert {(r.r, r.c): r.v for r in cells.collect()} == {(r, c): float(grid[r, c]) for r in range(5) for c in range(7) if (r, c) != (2, 3)}
        assert (region.west, region.north, region.nsres, region.rows, region.cols) == (500.0, 900.0, 10.0, 5, 7)
    with pytest.raises(ValueError):
        TF.decode(b"plain text")


def test_integer_grids_arrays_and_windows(spark, tmp_path):
    grid = np.array([[3, -9999, 8], [-1, 2_000_000_001, 5]], ">i4")
    (tmp_path / "d.bil").write_bytes(grid.tobytes())
    (tmp_path / "d.hdr").write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nnodata_value -9999\nbyteorder MSBFIRST\n")
    cells, _ = RA.read_int(spark, str(tmp_path / "d.bil"))
    assert {(r.r, r.c): r.v for r in cells.collect()} == {(0, 0): 3, (0, 2): 8, (1, 0): -1, (1, 1): 2_000_000_001, (1, 2): 5}
    RA.write_int(cells, str(tmp_path / "w"))
    assert {r.v for r in RA.read_window(spark, str(tmp_path / "w"), 0, 1, 0, 2).collect()} == {3, 8, 2_000_000_001, 5}
    assert RA.cells_of(np.array([[1.0, np.nan], [-9999.0, 4.0]]), spark, -9999.0).count() == 2
    with pytest.warns(UserWarning, match="not square"):
        RA.warn_unless_square(RA.Region(0, 0, 1.0, 2.0, 2, 2))


def test_links_as_lines_subnetworks_and_surveys(spark, tmp_path):
    cells = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("b", 1, 0), ("b", 5, 1)], "link string, node long, i int")
    numbered = spark.createDataFrame([("a", 1, 2), ("b", 2, 0)], "link string, cat long, tostream long")
    nodes = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (5, 1, 1)], "node long, r int, c int")
    got = {r.cat: r for r in NW.link_lines(cells, numbered, nodes, RA.Region(10.0, 30.0, 2.0, 2.0, 2, 4)).collect()}
    assert (got[1].x1, got[1].y1, got[1].x2, got[1].y2, got[1].tostream) == (11.0, 29.0, 13.0, 29.0, 2) and got[2].wkt == "LINESTRING (13.0 29.0, 13.0 27.0)"
    n = spark.createDataFrame([(0, [None]), (1, [1.0]), (2, [2.0]), (3, [3.0])], "id long, z array<double>")
    e = spark.createDataFrame([(1, 3, 1, 0, 5.0), (2, 3, 2, 0, float("nan")), (3, 0, 3, 0, 7.0)], "src long, dst long, cat long, seq int, z double")
    some = spark.createDataFrame([(2,), (3,)], "cat long")
    assert {r.src for r in NW.subnetwork(n, e, some)[1].collect()} == {2, 3} and {r.src for r in NW.subnetwork(n, e, some, False)[1].collect()} == {2}
    NW.write_subnetwork(n, e, some, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s/nodes")).count() == 3
    NW.write_json(n, e, str(tmp_path / "loose"), strict=False)
    assert any("NaN" in r.value for r in spark.read.text(str(tmp_path / "loose/links")).collect())
    t = spark.createDataFrame([("Bailey Run 1", 10.0, 1.0), ("Bailey Run 2", 30.0, 2.0), ("Creek", 30.0, 3.0)], "site string, northing double, easting double")
    assert [tuple(r) for r in NW.field_heads(t, "Bailey", least_northing=20).collect()] == [(2.0, 30.0)] and NW.field_heads(t, "Bailey", most_northing=20).count() == 1


def test_readers_without_topology_and_to_a_graph(spark):
    region = RA.Region(0, 30, 10, 10, 3, 4)
    cells = spark.createDataFrame([(r, c, float(r * 4 + c)) for r in range(3) for c in range(4)], "r int, c int, v double")
    lines = spark.createDataFrame([(1, 0, 5.0, 25.0), (1, 1, 25.0, 25.0), (2, 0, 25.0, 25.0), (2, 1, 25.0, 5.0)], "cat long, seq int, x double, y double")
    v, to = NW.read_segments(lines, {"z": cells, "A": None}, region)
    assert v.count() == 4 and {tuple(r) for r in to.collect()} == {(1, 0), (2, 0)}
    nodes, edges = NW.read_graph(lines, spark.createDataFrame([(1, 2), (2, 0)], "cat long, tostream long"), {"z": cells}, region)
    assert nodes.count() == 3 and {(r.src, r.dst) for r in edges.collect()} == {(2, 0)}


def test_node_link_json(spark, tmp_path):
    nodes = spark.createDataFrame([(0, [float("nan")]), (1, [9.0])], "id long, z array<double>")
    links = spark.createDataFrame([(1, 0, 1, [3.0, float("inf")])], "source long, target long, cat long, z array<double>")
    text = NW.document(nodes, links)
    assert "NaN" not in text and json.loads(text)["nodes"][0]["z"] == [None]
    (tmp_path / "g.json").write_text(text.replace('"links"', '"edges"'))
    n, e = NW.read_document(spark, str(tmp_path / "g.json"), ["z"], ["z"])
    assert n.count() == 2 and e.first().z == [3.0, None]
    NW.write_json(nodes, spark.createDataFrame([(1, 0, 1, 1, 2.0), (1, 0, 1, 0, 5.0)], "src long, dst long, cat long, seq int, z double"), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d/links")).first().z == [5.0, 2.0]


def test_records_and_profiles(spark, tmp_path):
    region = RA.Region(0, 30, 10, 10, 3, 4)
    cells = spark.createDataFrame([(r, c, float(r * 4 + c)) for r in range(3) for c in range(4)], "r int, c int, v double")
    lines = spark.createDataFrame([(1, 0, 5.0, 25.0), (1, 1, 5.0, 25.0), (1, 2, 25.0, 25.0), (2, 0, 1.0, 1.0)], "cat long, seq int, x double, y double")
    got = NW.read_records(lines, {"A": cells, "z": cells}, region, 2.0).orderBy("seq").collect()
    assert [(r.cat, r.A, r.z, r.s_down) for r in got] == [(1, 0.0, 0.0, 0.0), (1, 4.0, 2.0, 20.0)]
    with pytest.raises(NW.InvalidNetwork):
        NW.topology(lines)
    p = spark.createDataFrame([(7, 0, 1, 5.0), (8, 0, 2, 9.0), (8, 1, 1, 5.0)], "head long, i int, cat long, s double")
    NW.write_profiles(p, str(tmp_path / "p"))
    assert spark.read.option("sep", " ").option("header", True).csv(str(tmp_path / "p")).count() == 2


def test_matching(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "id long, x double, y double")
    b = spark.createDataFrame([(10, 3.0, 4.0), (11, 3.0, 4.0), (12, 500.0, 0.0)], "id long, x double, y double")
    assert [tuple(r) for r in E.nearest(a, b, 10.0).collect()] == [(1, 10, 5.0)]
    q = E.match_quality(b, a, 10.0).first()
    assert (q.recall, round(q.precision, 6), q.median_d) == (0.5, round(2 / 3, 6), 5.0)
    assert E.auc(spark.createDataFrame([(1.0, False), (2.0, True), (2.0, False)], "s double, p boolean"), "s", "p").first().auc == 0.75


def test_stream_of_vertices(spark, tmp_path):
    from thalweg.streaming.profiles import slope_area_bins

    src = tmp_path / "in"
    spark.range(50).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") / 10).alias("logA"), (-F.col("id") / 20).alias("logS")).write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, logA double, logS double").parquet(str(src))
    q = slope_area_bins(stream).writeStream.format("memory").queryName("bins").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert spark.table("bins").agg(F.sum("n")).first()[0] == 50
    finally:
        q.stop()


FAST = ["w4_channel_slope", "w5_chi", "w6_densify", "sa2_slope_area_break", "ch5_chi_split", "j1_link_endpoints", "r2_d8_receivers", "ag12_auc", "j16_edge_overlap", "sa4_binned_break", "w11_clean_edges", "r1_fill_level", "x16_coverage", "v15_floodplain_cut"]


@pytest.mark.parametrize("name", FAST)
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(catalog.ORACLE_SQL[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert ((a == b) | (a.isna() & b.isna())).all().all()


def test_entry_works_without_the_optional_parts(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(here):
        if name not in ("corpus_pipeline.py", "thalweg", ".git", ".tmp"):
            os.symlink(f"{here}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "thalweg")
    for name in os.listdir(f"{here}/thalweg"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{here}/thalweg/{name}", tmp_path / "thalweg" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'r2_d8_receivers' in q and not any(n.startswith('op') or n == 'pipeline' for n in q), sorted(q); print(len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
