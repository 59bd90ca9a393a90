"""Grids as a Spark data source, `grid`: cells (r, c, v) of a file or tiled folder, many tasks to a grid.

    register(spark)
    spark.read.format("grid").option("window", "100,199,0,299").load("/data/dem.tif")
    write_grid(cells, "/data/tiles", region)

A grid is blocks: strips or tiles of a GeoTIFF, bands of rows of a raw grid with a header, files of a tiled folder. The
driver reads the header alone; a task reads the bytes of its blocks and no others. A window (first and last row, first and
last column) chooses the blocks; it is an option and not taken from filters, as Spark 4.1 gives what one query of a DataFrame has
pushed into a Python source to all other queries of it, too.
Files are reached through pyarrow's file systems, so a path is a local one or a URI that these know (file, hdfs, s3).

The folder that is written holds versions; `grid.json` names the current one and is replaced in one step when all tasks
have ended, so a reader sees the old grid or the new one. What a failed job has written is deleted.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import tiff
from .raster import Region, header_of

#: Rows and columns of a block of a raw grid, and cells that a task reads.
BAND_ROWS, BAND_COLS = 256, 4096
TASK_CELLS = 4 << 20
INDEX = "grid.json"


class Store:
    """Ranged reads of one path."""

    def __init__(self, path: str):
        self.files, self.path = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def ranges(self, path: str | None = None):
        """read(at, n) of one open file."""
        opened = self.files.open_input_file(path or self.path)
        return lambda at, n: opened.read_at(n, at)

    def whole(self, path: str) -> bytes:
        with self.files.open_input_stream(path) as f:
            return f.read()

    def has(self, path: str) -> bool:
        return self.files.get_file_info(path).type == fs.FileType.File


@dataclass(frozen=True)
class Block:
    """Cells r to r + rows, c to c + cols, and where they are in a file."""

    r: int
    c: int
    rows: int
    cols: int
    at: int
    size: int
    file: str


class Raw:
    """32-bit numbers row by row, described by a text header beside them."""

    def __init__(self, store: Store, header: str, kind: str):
        self.region, self.missing, order = header_of(store.whole(header).decode())
        self.kind = np.dtype(f"{order}{kind}")
        self.path = store.path

    def blocks(self) -> Iterator[Block]:
        n = self.region
        for r in range(0, n.rows, BAND_ROWS):
            for c in range(0, n.cols, BAND_COLS):
                rows, cols = min(BAND_ROWS, n.rows - r), min(BAND_COLS, n.cols - c)
                yield Block(r, c, rows, cols, (r * n.cols + c) * self.kind.itemsize, rows * cols * self.kind.itemsize, self.path)

    def grid(self, block: Block, read) -> np.ndarray:
        if block.cols == self.region.cols:
            data = read(block.at, block.size)
        else:
            wide = self.kind.itemsize
            data = b"".join(read(block.at + k * self.region.cols * wide, block.cols * wide) for k in range(block.rows))
        return np.frombuffer(data, self.kind).reshape(block.rows, block.cols)


class Tagged:
    """A GeoTIFF file."""

    def __init__(self, store: Store):
        self.layout = tiff.Layout(store.ranges())
        self.region, self.missing, self.path = self.layout.region, self.layout.missing, store.path

    def blocks(self) -> Iterator[Block]:
        for r, c, rows, cols, at, size in self.layout.blocks():
            yield Block(r, c, rows, cols, at, size, self.path)

    def grid(self, block: Block, read) -> np.ndarray:
        return self.layout.block(read(block.at, block.size), block.r)[:block.rows, :block.cols]


class Tiled:
    """A folder that the source has written."""

    def __init__(self, store: Store):
        told = json.loads(store.whole(f"{store.path}/{INDEX}"))
        self.region, self.missing, self.kind = Region(**told["region"]), told["missing"], np.dtype(told["kind"])
        self.tile, self.places, self.path = told["tile"], told["tiles"], f"{store.path}/{told['version']}"

    def blocks(self) -> Iterator[Block]:
        n, tile = self.region, self.tile
        for tr, tc in self.places:
            rows, cols = min(tile, n.rows - tr * tile), min(tile, n.cols - tc * tile)
            yield Block(tr * tile, tc * tile, rows, cols, 0, rows * cols * self.kind.itemsize, f"{self.path}/{tr}-{tc}.grid")

    def grid(self, block: Block, read) -> np.ndarray:
        return np.frombuffer(read(0, block.size), self.kind).reshape(block.rows, block.cols)


def opened(path: str, header: str | None = None, kind: str = "f4") -> Raw | Tagged | Tiled:
    store = Store(path)
    if store.has(f"{store.path}/{INDEX}"):
        return Tiled(store)
    if header is None and path.lower().endswith((".tif", ".tiff")):
        return Tagged(store)
    return Raw(store, Store(header).path if header else store.path.rsplit(".", 1)[0] + ".hdr", kind)


class Blocks(InputPartition):
    def __init__(self, blocks: list[Block]):
        self.blocks = blocks


class GridReader(DataSourceReader):
    """Options: path, header (of a raw grid, by default the path with .hdr), kind (f4 or i4), window, taskCells."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.grid = opened(self.path, options.get("header"), options.get("kind", "f4"))
        n = self.grid.region
        r0, r1, c0, c1 = map(int, options["window"].split(",")) if "window" in options else (0, n.rows - 1, 0, n.cols - 1)
        self.rows, self.cols = (max(0, r0), min(n.rows - 1, r1)), (max(0, c0), min(n.cols - 1, c1))
        self.most = int(options.get("taskcells", TASK_CELLS))

    def partitions(self) -> list[Blocks]:
        (r0, r1), (c0, c1) = self.rows, self.cols
        out, cells = [[]], 0
        for b in self.grid.blocks():
            if b.r <= r1 and b.r + b.rows > r0 and b.c <= c1 and b.c + b.cols > c0:
                if cells and cells + b.rows * b.cols > self.most:
                    out.append([])
                    cells = 0
                out[-1].append(b)
                cells += b.rows * b.cols
        return [Blocks(x) for x in out]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        (r0, r1), (c0, c1) = self.rows, self.cols
        store, file, read = Store(self.path), None, None
        for b in partition.blocks:
            if b.file != file:
                file, read = b.file, store.ranges(b.file)
            part = self.grid.grid(b, read)
            top, left = max(0, r0 - b.r), max(0, c0 - b.c)
            part = part[top:r1 - b.r + 1, left:c1 - b.c + 1]
            ok = np.isfinite(part)
            if self.grid.missing is not None:
                ok &= part != part.dtype.type(self.grid.missing)
            r, c = np.nonzero(ok)
            yield pa.RecordBatch.from_arrays([
                pa.array((r + b.r + top).astype(np.int32)), pa.array((c + b.c + left).astype(np.int32)), pa.array(part[r, c].astype(np.float64))], names=["r", "c", "v"])


@dataclass
class Written(WriterCommitMessage):
    tiles: list[tuple[int, int]]


class GridWriter(DataSourceArrowWriter):
    """Options: path, region (as JSON), tile, missing, kind. Rows of a tile come together, in one task."""

    def __init__(self, options: dict):
        self.store, self.version = Store(options["path"]), f"v-{uuid.uuid4().hex}"
        self.region, self.tile = Region(**json.loads(options["region"])), int(options["tile"])
        self.missing, self.kind = float(options["missing"]), np.dtype(options["kind"])
        self.store.files.create_dir(f"{self.store.path}/{self.version}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, place, held = [], None, []
        for b in iterator:
            r, c, v = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if len(r) and not ((0 <= r) & (r < self.region.rows) & (0 <= c) & (c < self.region.cols)).all():
                raise ValueError("a cell lies outside the region")
            keys = np.stack([r // self.tile, c // self.tile], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(r)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if tuple(keys[x].tolist()) != place:
                    self._put(place, held, done)
                    place, held = tuple(keys[x].tolist()), []
                held.append((r[x:y], c[x:y], v[x:y]))
        self._put(place, held, done)
        return Written(done)

    def _put(self, place: tuple[int, int] | None, held: list, done: list) -> None:
        if place is None:
            return
        r, c, v = (np.concatenate(x) for x in zip(*held))
        r0, c0 = place[0] * self.tile, place[1] * self.tile
        grid = np.full((min(self.tile, self.region.rows - r0), min(self.tile, self.region.cols - c0)), self.missing, self.kind)
        at = (r - r0) * grid.shape[1] + c - c0
        if len(np.unique(at)) < len(at):
            raise ValueError("a cell comes twice")
        grid[r - r0, c - c0] = v
        final = f"{self.store.path}/{self.version}/{place[0]}-{place[1]}.grid"
        own = f"{final}.{uuid.uuid4().hex}"  # a second attempt of the task doesn't meet the first one's file
        with self.store.files.open_output_stream(own) as f:
            f.write(grid.tobytes())
        self.store.files.move(own, final)
        done.append(place)

    def commit(self, messages: list[Written | None]) -> None:
        tiles = Counter(tuple(t) for m in messages if m for t in m.tiles)
        if twice := [t for t, n in tiles.items() if n > 1]:
            self.abort(messages)
            raise ValueError(f"tiles from more than one task: {twice[:5]}")
        told = {"version": self.version, "region": asdict(self.region), "tile": self.tile, "missing": self.missing, "kind": self.kind.str, "tiles": sorted(tiles)}
        at = f"{self.store.path}/{INDEX}"
        with self.store.files.open_output_stream(f"{at}.{self.version}") as f:
            f.write(json.dumps(told).encode())
        self.store.files.move(f"{at}.{self.version}", at)
        for old in self.store.files.get_file_info(fs.FileSelector(self.store.path)):
            if old.type == fs.FileType.Directory and old.base_name.startswith("v-") and old.base_name != self.version:
                self.store.files.delete_dir(old.path)

    def abort(self, messages: list[Written | None]) -> None:
        self.store.files.delete_dir(f"{self.store.path}/{self.version}")


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> str:
        return "r int, c int, v double"

    def reader(self, schema) -> GridReader:
        return GridReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> GridWriter:
        if not overwrite:
            raise ValueError("a grid is written whole: use mode('overwrite')")
        return GridWriter(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(GridSource)
    return spark


def read_grid(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, **options) -> tuple[DataFrame, Region]:
    """Cells (r, c, v) and the region of a grid of any size; window: first and last row, first and last column (ends included)."""
    options |= {"window": ",".join(map(str, window))} if window else {}
    region = opened(path, options.get("header"), options.get("kind", "f4")).region
    return register(spark).read.format("grid").options(**options).load(path), region


def write_grid(cells: DataFrame, path: str, region: Region, value: str = "v", tile: int = 512, missing: float = -9999.0, kind: str = "<f4") -> None:
    """Write cells (r, c, value) as tiles; nulls, NaN and infinities are no data. An older grid there is replaced."""
    v = F.col(value).cast("double")
    rows = cells.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), v.alias("v"))
    place = [F.expr(f"{x} div {tile}") for x in "rc"]
    register(cells.sparkSession)
    rows.repartition(*place).sortWithinPartitions(*place).write.format("grid").mode("overwrite").options(
        region=json.dumps(asdict(region)), tile=tile, missing=missing, kind=kind).save(path)
