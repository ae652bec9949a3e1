"""Reprojection tile by tile: a row is a tile, and numpy works on all of its cells at once.

For each output tile the source tiles that its cells need are worked out once, each with the box of output cells that it
takes part in.  Where a source tile is, it makes a partial result for such a box: least and greatest value, sums of weights
and of weighted values.  Partial results of an output tile are then merged, so what moves is as large as the output,
and no output tile has its source tiles together, however many there are.  Source tiles come from a DataFrame, by
an equi-join on (tile_row, tile_col), or straight from a file, in which case they do not move at all.
"""

from __future__ import annotations

import math
import os
import socket
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sphere
from ..model import BadArgument, CellType, Grid, Resampler, cell_type
from ..sources.bigtiff import TileFile
from .settle import settle

#: How far a point may come back from a round trip, in units of its own system.
TOLERANCE = 0.01
#: Cells that are mapped at once.
STRIP = 1 << 18
Kernel = Callable[[np.ndarray], np.ndarray]
#: The weight of cells, by row or column, in rectangles from ... to.
Weigh = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def bilinear(x: np.ndarray) -> np.ndarray:
    return np.maximum(0, 1 - np.abs(x))


def bicubic(x: np.ndarray) -> np.ndarray:
    """The cubic convolution kernel with a = -0.5."""
    a = np.abs(x)
    return np.where(a < 1, 1.5 * a**3 - 2.5 * a**2 + 1, np.where(a < 2, -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2, 0))


def lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) <= 3, np.sinc(x) * np.sinc(x / 3), 0)


KERNELS: dict[str, Kernel] = {"bilinear": bilinear, "bicubic": bicubic, "lanczos": lanczos}


def rectangles(grid_from: Grid, grid_to: Grid, row: np.ndarray, col: np.ndarray, support: int = 0, area_check: bool = True) -> tuple[np.ndarray, ...]:
    """(valid, ul_col, ul_row, lr_col, lr_row) of cells of ``grid_from`` in ``grid_to``; zeros where not valid.

    The footprint of a cell is its diagonal to the right and down, wider by the support.
    """
    ps, size = grid_from.pixel_size, math.sqrt(2) * grid_from.pixel_size
    grow = (support - 0.5) * size if support else 0.0
    x, y = grid_from.ulx + col * ps, grid_from.uly - row * ps
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        lam, phi = sphere.inverse(grid_from.srs, x, y)
        back_x, back_y = sphere.forward(grid_from.srs, lam, phi)
        ok = (np.abs(back_x - x) <= TOLERANCE) & (np.abs(lam) <= math.pi + 1e-9) & (np.abs(phi) <= math.pi / 2 + 1e-9)
        if area_check:
            ok &= np.abs(back_y - y) <= TOLERANCE
        at = []
        for dx, dy in ((-grow, grow), (size + grow, -size - grow)):
            u, v = sphere.forward(grid_to.srs, *sphere.inverse(grid_from.srs, x + dx, y + dy))
            at += [(u - grid_to.ulx) / grid_to.pixel_size, (grid_to.uly - v) / grid_to.pixel_size]
        for a in at:
            ok &= (a >= 0) & (a < 2**53)
    a_col, a_row, b_col, b_row = (np.floor(np.where(ok, a, 0)).astype(np.int64) for a in at)
    return ok, a_col, a_row, np.maximum(a_col, b_col), np.maximum(a_row, b_row)


def sources(grid_out: Grid, grid_in: Grid, row: np.ndarray, col: np.ndarray, support: int = 0) -> tuple[np.ndarray, ...]:
    """``rectangles`` of output cells, as resamplers use them: one that leaves the source below or begins
    right of it gives none, one that ends right of it is cut."""
    ok, c0, r0, c1, r1 = rectangles(grid_out, grid_in, row, col, support)
    ok &= (c0 <= grid_in.n_cols - 1) & (r1 <= grid_in.n_rows - 1)
    return ok, c0, r0, np.minimum(c1, grid_in.n_cols - 1), r1


def tile_cells(g: Grid, tile: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Rows and columns of the cells of a tile, in row-major order, and its shape."""
    ts, across = g.tile_size, -(-g.n_cols // g.tile_size)
    r0, c0 = tile // across * ts, tile % across * ts
    shape = min(ts, g.n_rows - r0), min(ts, g.n_cols - c0)
    row, col = np.divmod(np.arange(shape[0] * shape[1]), shape[1])
    return row + r0, col + c0, shape


NEEDS = "out_tile long, tile_row int, tile_col int, top int, left int, bottom int, right int"


def needed_tiles(spark: SparkSession, grid_in: Grid, grid_out: Grid, r: Resampler = Resampler.MEAN, partition_size: int = 16, spent: Seconds | None = None) -> DataFrame:
    """(out_tile, tile_row, tile_col, top, left, bottom, right): the source tiles that the cells of each output tile need,
    each with the box of its cells, inclusive and counted from the tile's corner, that need it."""
    n = -(-grid_out.n_rows // grid_out.tile_size) * -(-grid_out.n_cols // grid_out.tile_size)
    ts, across = grid_in.tile_size, -(-grid_in.n_cols // grid_in.tile_size)
    names = ["out_tile", "tile_row", "tile_col", "top", "left", "bottom", "right"]

    def boxes(tile: int) -> np.ndarray:
        """[source tile, top, left, bottom, right] of an output tile."""
        row, col, shape = tile_cells(grid_out, tile)
        found = [np.zeros((0, 5), np.int64)]
        for k in range(0, row.size, STRIP):
            ok, c0, r0, c1, r1 = sources(grid_out, grid_in, row[k : k + STRIP], col[k : k + STRIP], r.support)
            at = np.flatnonzero(ok) + k
            c0, r0, c1, r1 = (x[ok] // ts for x in (c0, r0, c1, r1))
            if r is Resampler.NEAREST:
                c1, r1 = c0, r0
            for dr in range(int((r1 - r0).max(initial=-1)) + 1):
                for dc in range(int((c1 - c0).max(initial=-1)) + 1):
                    on = np.flatnonzero((r0 + dr <= r1) & (c0 + dc <= c1))
                    if not on.size:
                        continue
                    ids, (i, j) = (r0[on] + dr) * across + c0[on] + dc, np.divmod(at[on], shape[1])
                    # neighbours in a row that need the same tile are one run
                    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (i[1:] != i[:-1])]))
                    last = np.append(first[1:], ids.size) - 1
                    found.append(np.stack([ids[first], i[first], j[first], i[first], j[last]], axis=1))
        runs = np.concatenate(found)
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        cut = np.flatnonzero(np.concatenate([[True], runs[1:, 0] != runs[:-1, 0]])) if len(runs) else np.zeros(0, np.int64)
        if not cut.size:
            return runs
        low, high = np.minimum.reduceat(runs, cut), np.maximum.reduceat(runs, cut)
        return np.concatenate([low[:, :3], high[:, 3:]], axis=1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in (t for b in batches for t in b.column(0).to_pylist()):
            began = time.time()
            b = boxes(tile)
            if spent is not None:
                spent.add({"minbox": time.time() - began})
            cols = [b[:, 0] // across, b[:, 0] % across, *b.T[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), tile)), *(pa.array(x.astype(np.int32)) for x in cols)], names)

    tiles = spark.range(0, n, 1, max(1, -(-n // max(1, partition_size))))
    return tiles.mapInArrow(find, NEEDS)


def as_cells(value: np.ndarray, t: CellType) -> np.ndarray:
    """Cast once, truncated and held in the type's range."""
    if t.code[0] == "f":
        return value.astype(t.code).astype(float)
    return np.clip(np.trunc(value), t.least, t.most)


def _by_offset(tile: np.ndarray, box: tuple[np.ndarray, ...], near: tuple[np.ndarray, ...], r: Resampler, weigh: Weigh) -> tuple[np.ndarray, np.ndarray]:
    """``partial`` for many small rectangles: all their cells at one offset at once."""
    c0, r0, c1, r1 = near
    total, weight = np.full(c0.size, np.nan), np.zeros(c0.size)
    for dr in range(int((r1 - r0).max(initial=-1)) + 1):
        for dc in range(int((c1 - c0).max(initial=-1)) + 1):
            on = np.flatnonzero((r0 + dr <= r1) & (c0 + dc <= c1))
            row, col = r0[on] + dr, c0[on] + dc
            v = tile[row, col]
            on, row, col, v = (x[~np.isnan(v)] for x in (on, row, col, v))
            if r is Resampler.MIN:
                total[on] = np.fmin(total[on], v)
            elif r is Resampler.MAX:
                total[on] = np.fmax(total[on], v)
            else:
                w = weigh(col, box[0][on], box[2][on]) * weigh(row, box[1][on], box[3][on]) if r.support else 1.0
                total[on] = np.where(np.isnan(total[on]), 0, total[on]) + w * v
                weight[on] += w
    return total, weight


def _by_cell(tile: np.ndarray, box: tuple[np.ndarray, ...], near: tuple[np.ndarray, ...], r: Resampler, weigh: Weigh) -> tuple[np.ndarray, np.ndarray]:
    """``partial`` for few large rectangles: one after the other, each at once."""
    total, weight = np.full(near[0].size, np.nan), np.zeros(near[0].size)
    for k, (a, b, c, d) in enumerate(zip(*near, strict=True)):
        v = tile[b : d + 1, a : c + 1]
        there = ~np.isnan(v)
        if not there.any():
            continue
        if r is Resampler.MIN:
            total[k] = np.nanmin(v)
        elif r is Resampler.MAX:
            total[k] = np.nanmax(v)
        else:
            w = np.outer(weigh(np.arange(b, d + 1), box[1][k], box[3][k]), weigh(np.arange(a, c + 1), box[0][k], box[2][k])) if r.support else np.ones(v.shape)
            total[k], weight[k] = (w[there] * v[there]).sum(), w[there].sum()
    return total, weight


def partial(tile: np.ndarray, box: tuple[np.ndarray, ...], r: Resampler, scale: float, kernel: Kernel | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What the cells of one source tile add to rectangles (ul_col, ul_row, lr_col, lr_row), which may reach beyond it.

    Rectangles count from the tile's corner.  (value, weight): least or greatest value and 0, or the sum of weighted values
    and of weights; NaN where no cell of the tile takes part.  NaN cells take part in no resampler but
    nearest.  ``scale`` is the output's cell size by the input's.
    """
    c0, r0, c1, r1 = box
    high, wide = tile.shape
    if r is Resampler.NEAREST:
        inside = (c0 >= 0) & (r0 >= 0) & (c0 < wide) & (r0 < high)
        value = np.full(c0.size, np.nan)
        value[inside] = tile[r0[inside], c0[inside]]
        return value, np.zeros(c0.size)
    ss = r.support / scale
    how = kernel or KERNELS.get(r.value)
    near = np.maximum(c0, 0), np.maximum(r0, 0), np.minimum(c1, wide - 1), np.minimum(r1, high - 1)
    some = np.flatnonzero((near[0] <= near[2]) & (near[1] <= near[3]))
    total, weight = np.full(c0.size, np.nan), np.zeros(c0.size)
    if some.size:
        box, near = tuple(x[some] for x in box), tuple(x[some] for x in near)
        offsets = int((near[2] - near[0]).max() + 1) * int((near[3] - near[1]).max() + 1)
        each = _by_offset if offsets <= some.size else _by_cell
        total[some], weight[some] = each(tile, box, near, r, lambda at, low, high: how((at + 0.5 - (low + (high - low) / 2)) * ss) * ss)
    return total, weight


def add(r: Resampler, total: np.ndarray, weight: np.ndarray, value: np.ndarray, more: np.ndarray) -> None:
    """Merge a partial result into another one, in place."""
    if r in (Resampler.MIN, Resampler.MAX):
        (np.fmin if r is Resampler.MIN else np.fmax)(total, value, out=total)
        return
    on = ~np.isnan(value)
    total[on] = np.where(np.isnan(total[on]), 0, total[on]) + value[on]
    weight += more


class Seconds:
    """Times and counts of the steps by process, gathered from all tasks: {process: {step: seconds}}."""

    def __init__(self, spark: SparkSession):
        self.held = spark.sparkContext.accumulator({}, _Sums())

    def add(self, times: dict[str, float]) -> None:
        self.held.add({f"{socket.gethostname()}-{os.getpid()}": times})

    @property
    def value(self) -> dict[str, dict[str, float]]:
        return self.held.value


class _Sums(AccumulatorParam):
    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, value1: dict, value2: dict) -> dict:  # noqa: N802
        for process, times in value2.items():
            own = value1.setdefault(process, {})
            for k, v in times.items():
                own[k] = own.get(k, 0.0) + v
        return value1


class _Partials:
    """Partial results of the output tiles at hand, merged as far as they meet in this task."""

    def __init__(self, grid_in: Grid, grid_out: Grid, r: Resampler, kernel: Kernel | None, spent: Seconds | None):
        self.grid_in, self.grid_out, self.r, self.kernel, self.spent = grid_in, grid_out, r, kernel, spent
        self.held: dict[tuple, list] = {}
        self.cells = 0
        self.known: dict[tuple, tuple] = {}
        self.known_cells = 0

    def take(self, keys: tuple, need: tuple[int, ...], tile: np.ndarray) -> None:
        """``need`` is a row of ``needed_tiles``, ``tile`` the cells of its source tile."""
        began = time.time()
        out_tile, tile_row, tile_col, top, left, bottom, right = need
        n = (bottom - top + 1) * (right - left + 1)
        value, weight = np.full(n, np.nan), np.zeros(n)
        for k in range(0, n, STRIP):
            at, (ok, box) = slice(k, k + STRIP), self._rectangles(tuple(need), k, min(k + STRIP, n))
            value[at][ok], weight[at][ok] = partial(tile, box, self.r, self.grid_out.pixel_size / self.grid_in.pixel_size, self.kernel)
        shape = bottom - top + 1, right - left + 1
        self._merge((*keys, out_tile), (top, left, bottom, right), value.reshape(shape), weight.reshape(shape))
        if self.spent is not None:
            self.spent.add({"resample": time.time() - began})

    def _rectangles(self, need: tuple[int, ...], begin: int, end: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Rectangles of cells [begin, end) of a need's box, from the source tile's corner; grids of one shape share them."""
        if (need, begin) not in self.known:
            out_tile, tile_row, tile_col, top, left, _, right = need
            g, ts = self.grid_out, self.grid_out.tile_size
            across = -(-g.n_cols // ts)
            row, col = np.divmod(np.arange(begin, end), right - left + 1)
            ok, *box = sources(g, self.grid_in, row + top + out_tile // across * ts, col + left + out_tile % across * ts, self.r.support)
            corner = tile_col * self.grid_in.tile_size, tile_row * self.grid_in.tile_size
            if self.known_cells + end - begin > HELD:
                self.known, self.known_cells = {}, 0
            self.known[need, begin] = ok, tuple(x[ok] - corner[i % 2] for i, x in enumerate(box))
            self.known_cells += end - begin
        return self.known[need, begin]

    def _merge(self, key: tuple, box: tuple[int, int, int, int], value: np.ndarray, weight: np.ndarray) -> None:
        if key in self.held:
            old, old_value, old_weight = self.held.pop(key)
            self.cells -= old_value.size
            union = min(old[0], box[0]), min(old[1], box[1]), max(old[2], box[2]), max(old[3], box[3])
            if union != old:
                shape = union[2] - union[0] + 1, union[3] - union[1] + 1
                wide_value, wide_weight = np.full(shape, np.nan), np.zeros(shape)
                _view(wide_value, union, old)[:], _view(wide_weight, union, old)[:] = old_value, old_weight
                old_value, old_weight = wide_value, wide_weight
            add(self.r, _view(old_value, union, box), _view(old_weight, union, box), value, weight)
            box, value, weight = union, old_value, old_weight
        self.held[key] = [box, value, weight]
        self.cells += value.size

    def give(self, most: int = 0) -> Iterator[tuple[tuple, tuple, np.ndarray, np.ndarray]]:
        """Hand out what is held, if it is more than ``most`` cells."""
        if self.cells > most:
            for key, (box, value, weight) in self.held.items():
                yield key, box, value, weight
            self.held, self.cells = {}, 0


def _view(a: np.ndarray, box: tuple, part: tuple) -> np.ndarray:
    return a[part[0] - box[0] : part[2] - box[0] + 1, part[1] - box[1] : part[3] - box[1] + 1]


#: Cells of partial results that a task holds before it hands them out.
HELD = 1 << 22
#: Source tiles of one output tile beyond which their partial results are merged in two steps, first by neighbourhoods.
FAN = 256
STATE = ["out_tile", "tile_row", "tile_col", "top", "left", "bottom", "right", "value", "weight"]


def _state(r: Resampler, keys: list[pa.Array], rows: list[tuple]) -> list[pa.Array]:
    """Columns ``STATE`` of (out_tile, tile_row, tile_col, box, value, weight)."""
    lists = lambda k: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([x[k].size for x in rows])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0), *(x[k].ravel() for x in rows)])))
    if r in (Resampler.NEAREST, Resampler.MIN, Resampler.MAX):  # there are no weights
        rows = [(*x[:5], np.zeros(0)) for x in rows]
    boxes = [pa.array([x[3][k] for x in rows], pa.int32()) for k in range(4)]
    return [*keys, pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.int32()), *boxes, lists(4), lists(5)]


def _merged(states: DataFrame, keys: list[str], kinds: dict[str, str], grid_in: Grid, grid_out: Grid, r: Resampler, fill: float, fan: int) -> DataFrame:
    """Output tiles from partial results; rows without a box stand for output tiles that have none."""
    t, across = cell_type(grid_out.pixel_type), -(-grid_out.n_cols // grid_out.tile_size)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), NEEDS, "value array<double>, weight array<double>"])

    def merged(table: pa.Table) -> tuple[_Partials, pa.Table]:
        table = table.combine_chunks()
        held = _Partials(grid_in, grid_out, r, None, None)
        ids = [table[c].to_numpy() for c in ("out_tile", "tile_row", "tile_col", "top", "left", "bottom", "right")]
        for i in np.lexsort((ids[2], ids[1])):  # one order of summing
            box = tuple(int(x[i]) for x in ids[3:])
            shape = box[2] - box[0] + 1, box[3] - box[1] + 1
            if box[2] < 0:
                continue
            value = table["value"][int(i)].values.to_numpy(zero_copy_only=False).reshape(shape).copy()
            weight = table["weight"][int(i)].values.to_numpy(zero_copy_only=False)
            held._merge((int(ids[0][i]),), box, value, weight.reshape(shape).copy() if weight.size else np.zeros(shape))
        return held, table

    def some(table: pa.Table) -> pa.Table:
        held, table = merged(table)
        first = table.slice(0, 1)
        rows = [(key[-1], first["tile_row"][0].as_py(), first["tile_col"][0].as_py(), box, value, weight) for key, box, value, weight in held.give(-1)]
        if not rows:
            return first
        return pa.Table.from_arrays(_state(r, [first[k].combine_chunks() for k in keys], rows), names=[*keys, *STATE])

    def finish(table: pa.Table) -> pa.Table:
        held, table = merged(table)
        tile = table["out_tile"][0].as_py()
        row, col, shape = tile_cells(grid_out, tile)
        out = np.full(shape, np.nan)
        for _, box, value, weight in held.give(-1):
            if r is Resampler.MEAN or r.support:
                with np.errstate(invalid="ignore", divide="ignore"):
                    value = np.where(weight == 0, np.nan, value / weight)
            _view(out, (0, 0), box)[:] = value
        out = as_cells(np.where(np.isnan(out), fill, out), t).ravel()
        ints = [pa.array([v], pa.int32()) for v in (tile // across, tile % across, row[0], col[0], *shape)]
        first = table.slice(0, 1)
        data = pa.ListArray.from_arrays(pa.array([0, out.size], pa.int32()), pa.array(out))
        return pa.Table.from_arrays([*(first[k].combine_chunks() for k in keys), *ints, data], names=[*keys, "tile_row", "tile_col", "row0", "col0", "n_rows", "n_cols", "data"])

    if fan > FAN:
        near = states.withColumns({"_r": F.expr("tile_row div 8"), "_c": F.expr("tile_col div 8")})
        names = [*keys, *STATE]
        states = near.groupBy(*keys, "out_tile", "_r", "_c").applyInArrow(lambda t: some(t.select(names)), schema)
    out = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "tile_row int, tile_col int, row0 int, col0 int, n_rows int, n_cols int, data array<double>"])
    return states.groupBy(*keys, "out_tile").applyInArrow(finish, out)


def _empty(rasters: DataFrame, keys: list[str], grid_out: Grid) -> DataFrame:
    """A row without a box for each key and output tile."""
    n = -(-grid_out.n_rows // grid_out.tile_size) * -(-grid_out.n_cols // grid_out.tile_size)
    none = [F.lit(-1).alias(c) for c in STATE[1:7]] + [F.lit(None).cast("array<double>").alias(c) for c in STATE[7:]]
    return rasters.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("out_tile"), *none)


def plan_needs(spark: SparkSession, grid_in: Grid, grid_out: Grid, r: Resampler, partition_size: int, spent: Seconds | None = None) -> tuple[DataFrame, int]:
    """``needed_tiles``, worked out once, and the greatest number of source tiles of an output tile."""
    if grid_in.pixel_type != grid_out.pixel_type:
        raise BadArgument("source and destination have different cell types")
    needs = settle(needed_tiles(spark, grid_in, grid_out, r, partition_size, spent))
    return needs, needs.groupBy("out_tile").count().agg(F.max("count")).first()[0] or 0


def reproject_tiles(tiles: DataFrame, grid_in: Grid, grid_out: Grid, resampler: Resampler | str = Resampler.NEAREST, fill: float = 0.0, kernel: Kernel | None = None, partition_size: int = 16, rasters: DataFrame | None = None) -> DataFrame:
    """Tiles (keys, tile_row, tile_col, row0, col0, n_rows, n_cols, data) of ``grid_out`` for every key of ``tiles``.

    ``tiles`` are those of ``grid_in``, cut by its tile size; a missing tile or null cell counts as fill for
    nearest and takes no part elsewhere.  ``kernel`` replaces a weighted resampler's own.  ``rasters`` has the keys, once
    each; without it they are taken from all tiles.  Only source tiles within the rows and columns of tiles that are
    needed are read.  ``partition_size`` is the number of output tiles that one task maps.
    """
    spark, r = tiles.sparkSession, Resampler(resampler)
    keys = [c for c in tiles.columns if c not in ("tile_row", "tile_col", "row0", "col0", "n_rows", "n_cols", "data")]
    kinds = dict(tiles.dtypes)
    needs, fan = plan_needs(spark, grid_in, grid_out, r, partition_size)
    box = needs.agg(F.min("tile_row"), F.max("tile_row"), F.min("tile_col"), F.max("tile_col")).first()
    if rasters is None:
        rasters = tiles.select(*keys).distinct() if keys else spark.range(1).select()
    every = _empty(rasters, keys, grid_out)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), NEEDS, "value array<double>, weight array<double>"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Partials(grid_in, grid_out, r, kernel, None)
        for b in batches:
            cols = {c: b.column(c) for c in b.schema.names}
            needs_of = np.stack([cols[c].to_numpy() for c in STATE[:7]], axis=1).tolist()
            wide, own = cols["n_cols"].to_pylist(), list(zip(*(cols[k].to_pylist() for k in keys), strict=True)) or [()] * b.num_rows
            rows = []
            for i in range(b.num_rows):
                # one key is merged at a time, so that its Arrow values stay what they are
                held.take((), needs_of[i], cols["data"][i].values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, wide[i]))
                if i + 1 == b.num_rows or own[i + 1] != own[i] or held.cells > HELD:
                    for key, where, value, weight in held.give(-1):
                        rows.append((i, (key[-1], *needs_of[i][1:3], where, value, weight)))
            at = pa.array([x[0] for x in rows], pa.int32())
            yield pa.RecordBatch.from_arrays(_state(r, [cols[k].take(at) for k in keys], [x[1] for x in rows]), [*keys, *STATE])

    if box[0] is not None:
        near = tiles.where(F.col("tile_row").between(box[0], box[1]) & F.col("tile_col").between(box[2], box[3]))
        met = needs.join(near, ["tile_row", "tile_col"]).select(*keys, *STATE[:7], "n_cols", F.col("data").cast("array<double>").alias("data"))
        every = met.mapInArrow(make, schema).unionByName(every)
    return _merged(every, keys, kinds, grid_in, grid_out, r, fill, fan)


def spread(row: str, col: str, bits: int = 24) -> str:
    """The place of a tile along a curve that keeps neighbours together: its bits, row and column in turns."""
    return " | ".join(f"shiftleft(shiftright(CAST({c} AS BIGINT), {k}) & 1, {2 * k + (c == row)})" for k in range(bits) for c in (col, row))


def reproject_file(spark: SparkSession, path: str, grid_in: Grid, grid_out: Grid, resampler: Resampler | str = Resampler.NEAREST, fill: float = 0.0, kernel: Kernel | None = None, partition_size: int = 16, spent: Seconds | None = None) -> DataFrame:
    """The same from a file ("gridtiff"), with the key ``band``.

    The needed tiles are dealt out by neighbourhoods and read where their partial results are made: only they are read,
    each in one task, and no source tile moves.
    """
    r = Resampler(resampler)
    needs, fan = plan_needs(spark, grid_in, grid_out, r, partition_size, spent)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Partials(grid_in, grid_out, r, kernel, spent)

        def give(most: int) -> Iterator[pa.RecordBatch]:
            rows = [(key[0], (key[-1], at[0], at[1], box, value, weight)) for key, box, value, weight in held.give(most)]
            if rows:
                yield pa.RecordBatch.from_arrays(_state(r, [pa.array([x[0] for x in rows], pa.int32())], [x[1] for x in rows]), ["band", *STATE])

        at, bands = None, []
        with TileFile(path, grid_in.tile_size) as f:
            for b in batches:
                for need in np.stack([b.column(c).to_numpy() for c in STATE[:7]], axis=1).tolist():
                    if at != tuple(need[1:3]):
                        began = time.time()
                        at = tuple(need[1:3])
                        cells = f.tile(*at).astype(float)
                        bands = [cells[:, :, k] for k in range(cells.shape[2])]
                        if spent is not None:
                            spent.add({"read": time.time() - began, "tiles": 1})
                    for k, cells in enumerate(bands):
                        held.take((k + 1,), need, cells)
                    yield from give(HELD)
        yield from give(-1)

    dealt = needs.select("*", F.expr(spread("tile_row", "tile_col")).alias("_z")).repartitionByRange("_z").sortWithinPartitions("_z", "out_tile").drop("_z")
    states = dealt.mapInArrow(make, f"band int, {NEEDS}, value array<double>, weight array<double>")
    bands = spark.range(1, grid_in.n_bands + 1).selectExpr("CAST(id AS INT) AS band")
    return _merged(states.unionByName(_empty(bands, ["band"], grid_out)), ["band"], {"band": "int"}, grid_in, grid_out, r, fill, fan)
