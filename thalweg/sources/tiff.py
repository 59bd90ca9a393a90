"""GeoTIFF grids: one band, strips or tiles, plain or Deflate, any of the usual number types, classic or with 64-bit places."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .raster import Region, warn_unless_square

#: Tags (fixed by the format) that the reader uses.
WIDTH, LENGTH, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT, NO_DATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
#: Field type -> its struct letter: bytes, text, 16, 32 and 64 bits, fractions left out, signed ones, floats.
LETTERS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def tags(read: Callable[[int, int], bytes]) -> tuple[dict[int, tuple], str]:
    """The first image's fields by tag, and the file's byte order; read(at, n) gives bytes of the file."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack_from(f"{order}H", head, 2)[0] if order and len(head) >= 8 else None
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    wide = kind == 43
    place, count, entry, inline = ("Q", "Q", 20, 8) if wide else ("I", "H", 12, 4)
    (at,) = struct.unpack_from(f"{order}{place}", head, 8 if wide else 4)
    (n,) = struct.unpack(f"{order}{count}", read(at, struct.calcsize(count)))
    rows = read(at + struct.calcsize(count), n * entry)
    found = {}
    for k in range(n):
        tag, kind, size = struct.unpack_from(f"{order}HH{place}", rows, entry * k)
        if kind not in LETTERS:
            continue
        form = f"{order}{size}{LETTERS[kind]}"
        own = rows[entry * (k + 1) - inline:entry * (k + 1)]
        if struct.calcsize(form) > inline:
            own = read(struct.unpack(f"{order}{place}", own)[0], struct.calcsize(form))
        found[tag] = struct.unpack_from(form, own)
    return found, order


class Layout:
    """Where a file's blocks are and how their bytes become numbers, from its fields alone."""

    def __init__(self, read: Callable[[int, int], bytes]):
        t, order = tags(read)
        one = lambda tag, usual=None: t[tag][0] if tag in t else usual
        self.rows, self.cols, self.packed, self.predictor = one(LENGTH), one(WIDTH), one(COMPRESSION, 1), one(PREDICTOR, 1)
        if one(SAMPLES, 1) != 1 or self.packed not in (1, 8, 32946) or self.predictor not in (1, 2):
            raise ValueError("only one band, plain or Deflate, with no or horizontal prediction")
        self.kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(SAMPLE_FORMAT, 1)] }{one(BITS) // 8}")
        self.tiled = TILE_OFFSETS in t
        self.high, self.wide = (one(TILE_LENGTH), one(TILE_WIDTH)) if self.tiled else (one(ROWS_PER_STRIP, self.rows), self.cols)
        self.places = (t[TILE_OFFSETS], t[TILE_BYTES]) if self.tiled else (t[STRIP_OFFSETS], t[STRIP_BYTES])
        dx, dy = t.get(PIXEL_SCALE, (1.0, 1.0))[:2]
        i, j, _, x, y = t.get(TIE_POINT, (0.0, 0.0, 0.0, 0.0, float(self.rows)))[:5]
        self.region = Region(x - i * dx, y + j * dy, dx, dy, self.rows, self.cols)
        text = one(NO_DATA, b"").rstrip(b"\0 ").decode()
        self.missing = float(text) if text else None

    def blocks(self) -> Iterator[tuple[int, int, int, int, int, int]]:
        """Row, column, rows, columns, place and bytes of each strip or tile."""
        across = -(-self.cols // self.wide)
        for k, (at, size) in enumerate(zip(*self.places, strict=True)):
            r, c = k // across * self.high, k % across * self.wide
            yield r, c, min(self.high, self.rows - r), min(self.wide, self.cols - c), at, size

    def block(self, data: bytes, r: int) -> np.ndarray:
        """The numbers of the block that begins at row r, padding included."""
        data = data if self.packed == 1 else zlib.decompress(data)
        part = np.frombuffer(data, self.kind, (self.high if self.tiled else min(self.high, self.rows - r)) * self.wide).reshape(-1, self.wide)
        return np.cumsum(part, axis=1, dtype=self.kind) if self.predictor == 2 else part


def decode(data: bytes) -> tuple[np.ndarray, Region, float | None]:
    """The grid, its region (cells from the north) and its no-data value of a file in memory."""
    t = Layout(lambda at, n: data[at:at + n])
    grid = np.empty((t.rows, t.cols), t.kind)
    for r, c, rows, cols, at, size in t.blocks():
        grid[r:r + rows, c:c + cols] = t.block(data[at:at + size], r)[:rows, :cols]
    return grid, t.region, t.missing


def read_tiff(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> tuple[DataFrame, Region]:
    """Cells (r, c, v double) of one file of any size, or of a window of it; no-data cells are absent."""
    from .grid_source import read_grid

    cells, region = read_grid(spark, path, window)
    warn_unless_square(region)
    return cells, region
