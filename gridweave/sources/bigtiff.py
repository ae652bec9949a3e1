"""Georeferenced TIFF files as a Spark data source ("gridtiff"), in Arrow batches both ways.

Reading: classic TIFF and BigTIFF of either byte order, in tiles or strips, plain, deflated, LZW or PackBits, with
bands interleaved or apart.  A file in square tiles gives its own tiles; others give tiles of
``tilesize`` cells (256 by default) cut from its blocks.  One input partition is a run of tiles;
range filters on tile_row and tile_col prune tiles before any is read.  Blocks that a sparse file
leaves out have the nodata value, or 0.  A block that is cut off, cells that are not square, a turned grid and a file
without georeferencing raise an error.

Writing: uncompressed little-endian BigTIFF in tiles, or in strips (``layout`` "strip") of as many rows as a tile
has.  The header fixes every block's place, so tasks write their blocks straight to their places in a file beside the
target, and the commit adds the header and renames it; a failed job leaves no file, and a repeated task
writes the same bytes again.  A block must be dealt to one task: all bands of a tile, or all tiles of a row of tiles; ``write_grid``
deals them so.  Null cells and blocks that are not written have the nodata value.
Paths must be reachable from all machines.
"""

from __future__ import annotations

import json
import os
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.systems import POINT_CELLS, RASTER, from_keys, from_wkt, to_keys
from ..model import CELL_TYPES, Grid, GridIOError, cell_type
from . import codecs

SCHEMA = "band int, tile_row int, tile_col int, row0 int, col0 int, n_rows int, n_cols int, data array<{}>"
NAMES = ["band", "tile_row", "tile_col", "row0", "col0", "n_rows", "n_cols", "data"]

# Fixed values of the file format: bytes of a field type by its code, and tags.
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
FIELD_CODES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 284
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, EXTRA_SAMPLES, SAMPLE_FORMAT = 322, 323, 324, 325, 338, 339
STRIP_BYTES, PREDICTOR, COLOR_MAP = 279, 317, 320
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, GEO_DOUBLES, SRS_TEXT, NODATA = 33550, 33922, 34264, 34735, 34736, 34737, 42113
NO_COMPRESSION, LZW, PACKBITS, DEFLATE = 1, 5, 32773, (8, 32946)
PE_STRING = "ESRI PE String = "
#: Entries of the tables of blocks that are written at once.
PIECE = 1 << 20


@dataclass(frozen=True)
class Entries:
    """An array of a tag: its values, or where they stand in the file, so that no task reads all blocks' places."""

    values: tuple[int, ...] = ()
    at: int = 0
    code: str = ""

    def get(self, f: BinaryIO, i: int) -> int:
        if not self.code:
            return self.values[i]
        size = struct.calcsize(self.code)
        f.seek(self.at + i * size)
        return struct.unpack(self.code, f.read(size))[0]


@dataclass(frozen=True)
class Header:
    """``grid`` with the size of the tiles that are given; the file's blocks are block_rows x block_cols cells."""

    grid: Grid
    order: str
    offsets: Entries
    sizes: Entries
    block_rows: int
    block_cols: int
    tiled: bool = True
    compression: int = NO_COMPRESSION
    predictor: int = 1
    apart: bool = False

    @property
    def across(self) -> int:
        return -(-self.grid.n_cols // self.block_cols)

    def block(self, f: BinaryIO, i: int) -> np.ndarray:
        """Cells (row, col, band) of the file's i-th block of a band, which may be short at the lower edge."""
        if not self.apart:
            return self._cells(f, i, i, self.grid.n_bands)
        each = self.across * -(-self.grid.n_rows // self.block_rows)
        return np.concatenate([self._cells(f, i, i + band * each, 1) for band in range(self.grid.n_bands)], axis=2)

    def _cells(self, f: BinaryIO, i: int, k: int, bands: int) -> np.ndarray:
        g = self.grid
        kind = np.dtype(cell_type(g.pixel_type).code)
        rows = self.block_rows if self.tiled else min(self.block_rows, g.n_rows - i // self.across * self.block_rows)
        shape = (rows, self.block_cols, bands)
        at, size = self.offsets.get(f, k), self.sizes.get(f, k)
        if not at or not size:
            return np.full(shape, g.nodata or 0).astype(kind)
        f.seek(at)
        raw = f.read(size)
        if len(raw) < size:
            raise GridIOError(f"block {k}: the file ends within it")
        try:
            if self.compression in DEFLATE:
                raw = zlib.decompress(raw)
            elif self.compression == LZW:
                raw = codecs.lzw(raw)
            elif self.compression == PACKBITS:
                raw = codecs.packbits(raw)
        except zlib.error as e:
            raise GridIOError(f"block {k}: {e}") from e
        need = rows * self.block_cols * bands * kind.itemsize
        if len(raw) < need:
            raise GridIOError(f"block {k} has {len(raw)} of {need} bytes")
        a = np.frombuffer(raw[:need], kind.newbyteorder(self.order)).reshape(shape)
        return np.cumsum(a, axis=1, dtype=kind) if self.predictor == 2 else a.astype(kind, copy=False)


def _system(tags: dict) -> str:
    """The reference system: the text this engine writes, or what the file's keys say."""
    text = tags.get(SRS_TEXT, b"").split(b"\0")[0].decode("utf-8", "replace")
    cited = text.split("|")[0]
    if cited.startswith("+") or GEO_KEYS not in tags:
        return cited
    if PE_STRING in text:
        return from_wkt(text.partition(PE_STRING)[2].split("|")[0])
    return from_keys(tags[GEO_KEYS], tags.get(GEO_DOUBLES, ()), text)


def _place(path: str, tags: dict) -> tuple[float, float, float]:
    """Outer corner and cell size; only square cells of a grid that isn't turned are read."""
    if TRANSFORM in tags:
        t = tags[TRANSFORM]
        if len(t) != 16 or t[1] or t[4]:
            raise GridIOError(f"{path}: the grid is turned")
        wide, high, x, y = t[0], -t[5], t[3], t[7]
    elif PIXEL_SCALE in tags and len(tags.get(TIEPOINT, ())) >= 6:
        tie, (wide, high) = tags[TIEPOINT], tags[PIXEL_SCALE][:2]
        x, y = tie[3] - tie[0] * wide, tie[4] + tie[1] * high
    else:
        raise GridIOError(f"{path} has no georeferencing")
    if wide <= 0 or abs(wide - high) > 1e-9 * wide:
        raise GridIOError(f"{path}: cells of {wide} by {high} are not square")
    keys = tags.get(GEO_KEYS, ())
    if any(keys[k] == RASTER and keys[k + 3] == POINT_CELLS for k in range(4, len(keys) - 3, 4)):  # the tie is a cell's centre
        x, y = x - wide / 2, y + high / 2
    return x, y, wide


def read_header(path: str, tile_size: int = 256) -> Header:
    try:
        f = open(path, "rb")
    except OSError as e:
        raise GridIOError(str(e)) from e
    try:
        with f:
            return _header(path, f, tile_size)
    except struct.error as e:
        raise GridIOError(f"{path}: the header is cut off") from e
    except KeyError as e:
        raise GridIOError(f"{path}: tag {e} is missing") from e


def _header(path: str, f: BinaryIO, tile_size: int) -> Header:
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order and len(head) == 16 else 0
    if version not in (42, 43) or version == 43 and struct.unpack(order + "HH", head[4:8]) != (8, 0):
        raise GridIOError(f"{path} is not a TIFF file")
    big = version == 43
    count, offset, entry, room = ("Q", "Q", "HHQ8s", 8) if big else ("H", "I", "HHI4s", 4)
    f.seek(struct.unpack(order + offset, head[8:16] if big else head[4:8])[0])
    tags: dict = {}
    for _ in range(struct.unpack(order + count, f.read(struct.calcsize(order + count)))[0]):
        tag, kind, n, value = struct.unpack(order + entry, f.read(struct.calcsize(order + entry)))
        size = FIELD_BYTES.get(kind, 0) * n
        if not size or kind not in FIELD_CODES:
            continue
        code = FIELD_CODES[kind]
        lazy = tag in (TILE_OFFSETS, TILE_BYTES, STRIP_OFFSETS, STRIP_BYTES)
        if size > room:  # a single offset stands in the entry itself
            where = struct.unpack(order + offset, value)[0]
            if lazy:
                tags[tag] = Entries(at=where, code=order + code)
                continue
            at = f.tell()
            f.seek(where)
            value = f.read(size)
            f.seek(at)
        got = value[:size] if code == "s" else struct.unpack(f"{order}{n}{code}", value[:size])
        tags[tag] = Entries(got) if lazy else got
    compression, bands = tags.get(COMPRESSION, (1,))[0], tags.get(SAMPLES, (1,))[0]
    if compression not in (NO_COMPRESSION, LZW, PACKBITS, *DEFLATE):
        raise GridIOError(f"{path}: compression {compression} is not read")
    bits = tags.get(BITS, (1,))
    if len(set(bits)) > 1:
        raise GridIOError(f"{path}: bands of different types are not read")
    code = {1: "u", 2: "i", 3: "f"}.get(tags.get(SAMPLE_FORMAT, (1,))[0], "?") + str(bits[0] // 8)
    name = next((t.name for t in CELL_TYPES.values() if t.code == code), code)
    predictor = tags.get(PREDICTOR, (1,))[0]
    if predictor not in (1, 2) or predictor == 2 and code[0] == "f":
        raise GridIOError(f"{path}: predictor {predictor} is not read")
    rows, cols, tiled = tags[LENGTH][0], tags[WIDTH][0], TILE_OFFSETS in tags
    if tiled:
        high, wide, offsets, sizes = tags[TILE_LENGTH][0], tags[TILE_WIDTH][0], tags[TILE_OFFSETS], tags[TILE_BYTES]
    else:
        high, wide = min(rows, tags.get(ROWS_PER_STRIP, (rows,))[0]), cols
        offsets, sizes = tags[STRIP_OFFSETS], tags[STRIP_BYTES]
    x, y, cell = _place(path, tags)
    nodata = tags.get(NODATA, b"").split(b"\0")[0].decode().strip()
    colors = None
    if COLOR_MAP in tags and bands == 1 and name in ("Byte", "UInt16"):
        n = len(tags[COLOR_MAP]) // 3
        colors = tuple(zip(*(tags[COLOR_MAP][k * n : (k + 1) * n] for k in range(3)), strict=True))
    g = Grid(_system(tags), x, y, cell, rows, cols, name, bands, float(nodata) if nodata else None, wide if tiled and high == wide else tile_size, colors)
    return Header(g, order, offsets, sizes, high, wide, tiled, compression, predictor, bands > 1 and tags.get(PLANAR, (1,))[0] == 2)


class TileFile:
    """An open file, from which tiles and windows of cells are read; blocks of one row of windows are kept."""

    def __init__(self, path: str, tile_size: int = 256):
        self.header = read_header(path, tile_size)
        self.grid, self.f = self.header.grid, open(path, "rb")
        self.kept: dict[int, np.ndarray] = {}
        self.row = -1

    def __enter__(self) -> TileFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.f.close()

    def window(self, r0: int, c0: int, rows: int, cols: int) -> np.ndarray:
        """Cells (row, col, band) from (r0, c0) on."""
        h = self.header
        if r0 != self.row:
            self.kept, self.row = {}, r0
        out = np.empty((rows, cols, self.grid.n_bands), cell_type(self.grid.pixel_type).code)
        for i in range(r0 // h.block_rows, (r0 + rows - 1) // h.block_rows + 1):
            for j in range(c0 // h.block_cols, (c0 + cols - 1) // h.block_cols + 1):
                k = i * h.across + j
                if k not in self.kept:
                    self.kept[k] = h.block(self.f, k)
                top, left = i * h.block_rows - r0, j * h.block_cols - c0  # of the block in the window
                part = self.kept[k][max(0, -top) : rows - top, max(0, -left) : cols - left]
                out[max(0, top) : max(0, top) + part.shape[0], max(0, left) : max(0, left) + part.shape[1]] = part
        return out

    def tile(self, r: int, c: int) -> np.ndarray:
        g, ts = self.grid, self.grid.tile_size
        return self.window(r * ts, c * ts, min(ts, g.n_rows - r * ts), min(ts, g.n_cols - c * ts))


@dataclass(frozen=True)
class Plan:
    """Where all stands in a file that is written: ``head`` is what comes before the tables of blocks."""

    grid: Grid
    strips: bool
    head: bytes
    offsets_at: int
    sizes_at: int
    first: int

    @property
    def across(self) -> int:
        return -(-self.grid.n_cols // self.grid.tile_size)

    @property
    def n(self) -> int:
        down = -(-self.grid.n_rows // self.grid.tile_size)
        return down if self.strips else down * self.across

    @property
    def cell_bytes(self) -> int:
        return int(cell_type(self.grid.pixel_type).code[1]) * self.grid.n_bands

    @property
    def size(self) -> int:
        """Bytes of a block, but for a last, shorter strip."""
        return self.grid.tile_size * (self.grid.n_cols if self.strips else self.grid.tile_size) * self.cell_bytes

    def sizes(self, a: int, b: int) -> np.ndarray:
        out = np.full(b - a, self.size, "<u8")
        if self.strips and b == self.n:
            out[-1] = (self.grid.n_rows - (self.n - 1) * self.grid.tile_size) * self.grid.n_cols * self.cell_bytes
        return out


def file_plan(g: Grid, layout: str = "tile") -> Plan:
    if layout not in ("tile", "strip"):
        raise GridIOError(f"layout {layout} is not known")
    t, ts, strips = cell_type(g.pixel_type), g.tile_size, layout == "strip"
    n = Plan(g, strips, b"", 0, 0, 0).n
    shape = [(ROWS_PER_STRIP, 4, (ts,)), (STRIP_OFFSETS, 16, None), (STRIP_BYTES, 16, None)] if strips else [(TILE_WIDTH, 4, (ts,)), (TILE_LENGTH, 4, (ts,)), (TILE_OFFSETS, 16, None), (TILE_BYTES, 16, None)]
    entries = [
        (WIDTH, 4, (g.n_cols,)), (LENGTH, 4, (g.n_rows,)), (BITS, 3, (int(t.code[1]) * 8,) * g.n_bands), (COMPRESSION, 3, (1,)), (PHOTOMETRIC, 3, (3 if g.colors else 1,)), (SAMPLES, 3, (g.n_bands,)), (PLANAR, 3, (1,)),
        *shape, (SAMPLE_FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[t.code[0]],) * g.n_bands),
        (PIXEL_SCALE, 12, (g.pixel_size, g.pixel_size, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, g.ulx, g.uly, 0.0)),
    ]
    if g.n_bands > 1:
        entries.append((EXTRA_SAMPLES, 3, (0,) * (g.n_bands - 1)))
    if g.colors:
        entries.append((COLOR_MAP, 3, tuple(c[k] for k in range(3) for c in g.colors)))
    if g.srs:
        directory, numbers, text = to_keys(g.srs)
        entries += [(GEO_KEYS, 3, directory), (SRS_TEXT, 2, text), *([(GEO_DOUBLES, 12, numbers)] if numbers else [])]
    if g.nodata is not None:
        entries.append((NODATA, 2, repr(g.nodata).encode() + b"\0"))
    entries.sort()
    begin = 16 + 8
    at = begin + 20 * len(entries) + 8
    rest = {tag: v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{FIELD_CODES[kind]}", *v) for tag, kind, v in entries if v is not None}
    tables = at + sum(len(raw) for raw in rest.values() if len(raw) > 8)
    places, ifd, tail = {}, struct.pack("<Q", len(entries)), b""
    for k, (tag, kind, v) in enumerate(entries):
        if v is None:
            places[tag] = tables + 8 * n * len(places) if n > 1 else begin + 20 * k + 12  # a single one stands in its entry
            ifd += struct.pack("<HHQQ", tag, kind, n, places[tag] if n > 1 else 0)
        elif len(rest[tag]) > 8:
            ifd += struct.pack("<HHQQ", tag, kind, len(v), at + len(tail))
            tail += rest[tag]
        else:
            ifd += struct.pack("<HHQ8s", tag, kind, len(v), rest[tag])
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + ifd + struct.pack("<Q", 0) + tail
    return Plan(g, strips, head, *places.values(), tables + (16 * n if n > 1 else 0))


class _Tiles(InputPartition):
    def __init__(self, tiles: list[tuple[int, int]]):
        self.tiles = tiles


def tile_batch(a: np.ndarray, g: Grid, r: int, c: int) -> pa.RecordBatch:
    """A tile's cells (row, col, band) as rows of the source's schema, one a band."""
    rows, cols, bands = a.shape
    values = np.moveaxis(a, 2, 0).reshape(-1).astype(cell_type(g.pixel_type).wide)
    data = pa.ListArray.from_arrays(pa.array(np.arange(bands + 1, dtype=np.int32) * (rows * cols)), pa.array(values))
    same = [pa.array(np.full(bands, x, np.int32)) for x in (r, c, r * g.tile_size, c * g.tile_size, rows, cols)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(1, bands + 1, dtype=np.int32)), *same, data], NAMES)


class TiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.each = int(options.get("tilesPerPartition", 16))
        self.tile_size = int(options.get("tilesize", 256))
        self.bounds: dict[str, list[int]] = {"tile_row": [0, 2**31], "tile_col": [0, 2**31]}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else ""
            if name in self.bounds and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                b = self.bounds[name]
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    b[0] = max(b[0], f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    b[1] = min(b[1], f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        g = read_header(self.path, self.tile_size).grid
        down, across = -(-g.n_rows // g.tile_size), -(-g.n_cols // g.tile_size)
        (r0, r1), (c0, c1) = self.bounds["tile_row"], self.bounds["tile_col"]
        tiles = [(r, c) for r in range(max(0, r0), min(down - 1, r1) + 1) for c in range(max(0, c0), min(across - 1, c1) + 1)]
        return [_Tiles(tiles[i : i + self.each]) for i in range(0, len(tiles), self.each)]

    def read(self, partition: _Tiles) -> Iterator[pa.RecordBatch]:
        with TileFile(self.path, self.tile_size) as f:
            for r, c in partition.tiles:
                yield tile_batch(f.tile(r, c), f.grid, r, c)


@dataclass
class _Written(WriterCommitMessage):
    """Blocks that a task wrote, those of them that had not all their parts, and seconds spent."""

    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    partial: tuple[int, ...] = ()
    seconds: float = 0.0


class TiffWriter(DataSourceArrowWriter):
    """Takes tiles (band, tile_row, tile_col, n_rows, n_cols, data); every tile once a band."""

    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        o = options
        self.path, self.overwrite, self.layout, self.timings = o["path"], overwrite, o.get("layout", "tile"), o.get("timings")
        colors = tuple(map(tuple, json.loads(o["colors"]))) if o.get("colors") else None
        self.grid = Grid(o.get("srs", ""), float(o["ulx"]), float(o["uly"]), float(o["pixelsize"]), int(o["nrows"]), int(o["ncols"]), o.get("pixeltype", "Float64"), int(o.get("nbands", 1)), float(o["nodata"]) if o.get("nodata") else None, int(o.get("tilesize", 256)), colors)
        self.staging = f"{self.path}.part-{uuid.uuid4().hex}"
        file_plan(self.grid, self.layout)  # raises here if the system cannot be stated

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        g, plan, began, spent = self.grid, file_plan(self.grid, self.layout), time.time(), 0.0
        t, ts = cell_type(g.pixel_type), g.tile_size
        empty, parts = g.nodata or 0, (plan.across if plan.strips else 1) * g.n_bands
        open_blocks: dict[int, list] = {}
        done: list[int] = []
        out = os.open(self.staging, os.O_RDWR | os.O_CREAT, 0o644)

        def put(k: int, a: np.ndarray) -> None:
            view, at = memoryview(a.astype(np.dtype(t.code).newbyteorder("<"), copy=False).tobytes()), plan.first + k * plan.size
            while view:
                n = os.pwrite(out, view[: 1 << 24], at)
                view, at = view[n:], at + n
            done.append(k)

        try:
            for b in iterator:
                began = time.time()
                col = {c: b.column(c) for c in b.schema.names}
                ints = {c: col[c].to_numpy() for c in ("tile_row", "tile_col", "n_rows", "n_cols")}
                bands = col["band"].to_numpy() if "band" in col else np.ones(b.num_rows, np.int64)
                for i in range(b.num_rows):
                    r, c, rows, cols = (int(ints[x][i]) for x in ints)
                    values = col["data"][i].values
                    values = values.fill_null(pa.scalar(empty).cast(values.type)) if values.null_count else values
                    cells = values.to_numpy(zero_copy_only=False).reshape(rows, cols)
                    if cells.dtype.kind == "f" and t.code[0] != "f":
                        cells = np.where(np.isnan(cells), empty, cells)
                    k = r if plan.strips else r * plan.across + c
                    if k not in open_blocks:
                        high = min(ts, g.n_rows - r * ts) if plan.strips else ts
                        open_blocks[k] = [np.full((high, g.n_cols if plan.strips else ts, g.n_bands), empty).astype(t.code), 0]
                    left = c * ts if plan.strips else 0
                    open_blocks[k][0][:rows, left : left + cols, int(bands[i]) - 1] = cells.astype(t.code)
                    open_blocks[k][1] += 1
                    if open_blocks[k][1] == parts:
                        put(k, open_blocks.pop(k)[0])
                spent += time.time() - began
            began = time.time()
            partial = tuple(open_blocks)
            for k, (a, _) in open_blocks.items():
                put(k, a)
            os.fsync(out)
        finally:
            os.close(out)
        return _Written(np.array(done, np.int64), partial, spent + time.time() - began)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.path) and not self.overwrite:
            self._clean()
            raise GridIOError(f"{self.path} exists")
        began, plan = time.time(), file_plan(self.grid, self.layout)
        told = [m for m in messages if m]
        have = np.concatenate([np.zeros(0, np.int64), *(m.blocks for m in told)])
        have.sort()
        if (have[1:] == have[:-1]).any():
            self._clean()
            raise GridIOError(f"{self.path}: parts of a block were dealt to several tasks; write_grid() deals them to one")
        with open(self.staging, "r+b" if os.path.exists(self.staging) else "w+b") as out:
            out.write(plan.head)
            for a in range(0, plan.n, PIECE):
                b = min(plan.n, a + PIECE)
                there = np.zeros(b - a, bool)
                there[have[np.searchsorted(have, a) : np.searchsorted(have, b)] - a] = True  # others are sparse: nodata
                sizes = np.where(there, plan.sizes(a, b), 0).astype("<u8")
                offsets = np.where(there, plan.first + np.arange(a, b) * plan.size, 0).astype("<u8")
                for at, x in ((plan.offsets_at, offsets), (plan.sizes_at, sizes)):
                    out.seek(at + 8 * a)
                    out.write(x.tobytes())
            out.truncate(plan.first + (plan.n - 1) * plan.size + int(plan.sizes(plan.n - 1, plan.n)[0]))
        os.replace(self.staging, self.path)
        if self.timings:
            with open(self.timings, "w") as f:
                json.dump({"tasks": [m.seconds for m in told], "commit": time.time() - began, "partial": sum(len(m.partial) for m in told)}, f)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        if os.path.exists(self.staging):
            os.remove(self.staging)


class GridTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridtiff"

    def schema(self) -> str:
        return SCHEMA.format(cell_type(read_header(self.options["path"]).grid.pixel_type).spark.simpleString())

    def reader(self, schema: StructType) -> TiffReader:
        return TiffReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TiffWriter:
        return TiffWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters passed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridTiff)


def options(g: Grid) -> dict[str, str]:
    """Writer options of a grid."""
    o = {"srs": g.srs, "ulx": repr(g.ulx), "uly": repr(g.uly), "pixelsize": repr(g.pixel_size), "nrows": str(g.n_rows), "ncols": str(g.n_cols), "pixeltype": g.pixel_type, "nbands": str(g.n_bands), "tilesize": str(g.tile_size)}
    o |= {"colors": json.dumps(g.colors)} if g.colors else {}
    return o if g.nodata is None else o | {"nodata": repr(g.nodata)}


def write_grid(tiles: DataFrame, g: Grid, path: str, layout: str = "tile", **more: str) -> None:
    """Write tiles, the parts of each block dealt to one task.

    Tiles of one band go from where they are; all bands of a tile, or with ``layout`` "strip" all tiles of a row
    of tiles, meet in a task, which holds one such block at a time.
    """
    if layout == "strip":
        tiles = tiles.repartitionByRange("tile_row").sortWithinPartitions("tile_row")
    elif g.n_bands > 1:
        tiles = tiles.repartition("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col")
    tiles.write.format("gridtiff").options(**options(g), layout=layout, **more).mode("overwrite").save(path)
