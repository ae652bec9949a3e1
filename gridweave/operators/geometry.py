"""Coordinates, output sizing, partitions, and the map from output cells to source rectangles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sphere
from ..functions.projections import forward, inverse, lit, parse
from ..model import BadArgument, Grid
from .tilewise import STRIP, TOLERANCE, rectangles


def to_projected(g: Grid, col: str = "col", row: str = "row") -> tuple[str, str]:
    """Upper left corner of a cell."""
    return f"({col}*{lit(g.pixel_size)} + {lit(g.ulx)})", f"({lit(g.uly)} - {row}*{lit(g.pixel_size)})"


def to_raster(g: Grid, x: str, y: str) -> tuple[str, str]:
    return f"(({x} - {lit(g.ulx)})/{lit(g.pixel_size)})", f"(({lit(g.uly)} - {y})/{lit(g.pixel_size)})"


def cells(spark: SparkSession, n_rows: int, n_cols: int, row0: int = 0, col0: int = 0) -> DataFrame:
    """(row, col) of a rectangle; rows are dealt over tasks, columns are made in them."""
    rows = spark.range(row0, row0 + n_rows).select(F.col("id").cast("int").alias("row"))
    return rows.select("row", F.explode(F.sequence(F.lit(col0), F.lit(col0 + n_cols - 1))).alias("col"))


def pixel_map_steps(grid_from: Grid, grid_to: Grid, support: int = 0, area_check: bool = True) -> list[dict[str, str]]:
    """Columns, level by level, that map cells (row, col) of ``grid_from`` to rectangles of
    ``grid_to``: ``valid`` and ``ul_col, ul_row, lr_col, lr_row`` (inclusive; NULL if not valid).

    The footprint of a cell is its diagonal to the right and down, wider by the support.
    """
    x, y = to_projected(grid_from)
    size = math.sqrt(2 * grid_from.pixel_size**2)
    grow = (support - 0.5) * size if support else 0.0
    back = f"abs(x_back - x) <= {TOLERANCE}e0"
    if area_check:
        back += f" AND abs(y_back - y) <= {TOLERANCE}e0"
    lam, phi = inverse(grid_from.srs, "x", "y")
    bx, by = forward(grid_from.srs, "lam", "phi")
    steps = [{"x": x, "y": y}, {"lam": lam, "phi": phi}, {"x_back": bx, "y_back": by}]
    steps.append({"ok": f"coalesce({back} AND abs(lam) <= {lit(math.pi + 1e-9)} AND abs(phi) <= {lit(math.pi / 2 + 1e-9)}, false)"})
    corners = {"a": (f"(x - {lit(grow)})", f"(y + {lit(grow)})"), "b": (f"(x + {lit(size + grow)})", f"(y - {lit(size + grow)})")}
    steps.append({f"{k}_{n}": f"CASE WHEN ok THEN {v} END" for k, c in corners.items() for n, v in zip("xy", c, strict=True)})
    steps.append({f"{k}_{n}": v for k in corners for n, v in zip(("lam", "phi"), inverse(grid_from.srs, f"{k}_x", f"{k}_y"), strict=True)})
    steps.append({f"{k}_{n}": v for k in corners for n, v in zip(("u", "v"), forward(grid_to.srs, f"{k}_lam", f"{k}_phi"), strict=True)})
    steps.append({f"{k}_{n}": v for k in corners for n, v in zip(("col", "row"), to_raster(grid_to, f"{k}_u", f"{k}_v"), strict=True)})
    steps.append({"valid": "coalesce(a_col >= 0e0 AND a_row >= 0e0 AND b_col >= 0e0 AND b_row >= 0e0, false)"})
    whole = lambda c: f"CAST(floor(CASE WHEN valid THEN {c} END) AS BIGINT)"
    steps.append({"ul_col": whole("a_col"), "ul_row": whole("a_row"), "lr_col": whole("greatest(a_col, b_col)"), "lr_row": whole("greatest(a_row, b_row)")})
    return steps


MAP = ["valid", "ul_col", "ul_row", "lr_col", "lr_row"]


def pixel_map(df: DataFrame, grid_from: Grid, grid_to: Grid, support: int = 0, area_check: bool = True) -> DataFrame:
    """``df`` (row, col of ``grid_from``) with the columns ``MAP``; numpy maps a batch of cells at once.

    As one expression the map is more code than the JVM compiles; ``pixel_map_sql`` is its form in SQL.
    """
    names = [*df.columns, *MAP]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, col = (b.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
            ok, *box = rectangles(grid_from, grid_to, row, col, support, area_check)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok), *(pa.array(x, mask=~ok) for x in box)], names)

    schema = ", ".join([*(f"`{k}` {v}" for k, v in df.dtypes), "valid boolean, ul_col long, ul_row long, lr_col long, lr_row long"])
    return df.mapInArrow(run, schema)


def pixel_map_sql(cells_sql: str, grid_from: Grid, grid_to: Grid, support: int = 0) -> str:
    """The same as SQL over a query of (row, col)."""
    for s in pixel_map_steps(grid_from, grid_to, support):
        cells_sql = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in s.items())} FROM ({cells_sql}) s"
    return cells_sql


def transform_points(df: DataFrame, srs: str, x: str, y: str, to: tuple[str, str], back: bool = False) -> DataFrame:
    """``df`` with two columns ``to``: longitude ``x`` and latitude ``y`` (radians) in ``srs``, or with ``back``
    the longitude and latitude of its points; null outside the projection's domain."""
    names = [*df.columns, *to]
    s = parse(srs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (x, y)]
            got = (sphere.inverse if back else sphere.forward)(s, *at)
            bad = np.isnan(got[0]) | np.isnan(got[1])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, pa.float64(), mask=bad) for v in got)], names)

    schema = ", ".join([*(f"`{k}` {v}" for k, v in df.dtypes), *(f"`{c}` double" for c in to)])
    return df.mapInArrow(run, schema)


def border_bands(g: Grid, mode: str = "strict", buffer: int = 10) -> list[tuple[int, int, int, int]]:
    """(row, last row, col, last col) of the cells whose corners are scanned for an extent.

    "strict" scans the bottom, left and right bands; "corrected" all four and the outer edge.
    """
    rb, cb = min(buffer, g.n_rows), min(buffer, g.n_cols)
    if mode == "strict":
        return [(g.n_rows - rb - 1, g.n_rows - 1, 0, g.n_cols - 1), (0, g.n_rows - 1, 0, cb), (0, g.n_rows - 1, g.n_cols - cb - 1, g.n_cols - 1)]
    return [(0, rb, 0, g.n_cols), (g.n_rows - rb, g.n_rows, 0, g.n_cols), (0, g.n_rows, 0, cb), (0, g.n_rows, g.n_cols - cb, g.n_cols)]


def projected_minbox(spark: SparkSession, g: Grid, srs: str, mode: str = "strict") -> DataFrame:
    """One row (ulx, uly, lrx, lry): the extent of ``g`` in ``srs``; points outside are left out."""
    parts = [cells(spark, r1 - r0 + 1, c1 - c0 + 1, r0, c0) for r0, r1, c0, c1 in border_bands(g, mode)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    s, t, names = parse(g.srs), parse(srs), ["ulx", "uly", "lrx", "lry"]

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, col = (b.column(c).to_numpy().astype(float) for c in ("row", "col"))
            u, v = sphere.forward(t, *sphere.inverse(s, col * g.pixel_size + g.ulx, g.uly - row * g.pixel_size))
            ok = np.isfinite(u) & np.isfinite(v)
            if ok.any():
                u, v = u[ok], v[ok]
                yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in (u.min(), v.max(), u.max(), v.min())], names)

    found = every.mapInArrow(box, "ulx double, uly double, lrx double, lry double")
    return found.agg(F.min("ulx").alias("ulx"), F.max("uly").alias("uly"), F.max("lrx").alias("lrx"), F.min("lry").alias("lry"))


def minbox_sql(g: Grid, srs: str, mode: str = "strict") -> str:
    x, y = to_projected(g)
    lam, phi = inverse(g.srs, "x", "y")
    u, v = forward(srs, "lam", "phi")
    bands = " UNION ALL ".join(f"SELECT r AS row, c AS col FROM range({r0}, {r1 + 1}) a(r), range({c0}, {c1 + 1}) b(c)" for r0, r1, c0, c1 in border_bands(g, mode))
    return f"SELECT min({u}) AS ulx, max({v}) AS uly, max({u}) AS lrx, min({v}) AS lry FROM (SELECT {lam} AS lam, {phi} AS phi FROM (SELECT {x} AS x, {y} AS y FROM ({bands}) q) p) o"


SIZE = "CAST(floor(0.5e0 + (lrx - ulx)/ps) AS BIGINT) AS n_cols, CAST(floor(0.5e0 + (uly - lry)/ps) AS BIGINT) AS n_rows"


def _size_expr(g: Grid, ratio: float, max_dim: int | None) -> str:
    if max_dim:
        return f"{lit(ratio)}*greatest(lrx - ulx, uly - lry)/{lit(max_dim)}"
    return f"{lit(ratio)}*sqrt((lrx - ulx)*(lrx - ulx) + (uly - lry)*(uly - lry))/{lit(math.hypot(g.n_rows, g.n_cols))}"


def output_size(spark: SparkSession, g: Grid, srs: str, ratio: float = 1.0, max_dim: int | None = None, mode: str = "strict") -> DataFrame:
    """One row (ulx, uly, pixel_size, n_rows, n_cols): cells of the input's diagonal, or a preview
    of at most ``max_dim`` cells to a side."""
    if ratio <= 0:
        raise BadArgument("the output ratio must be positive")
    box = projected_minbox(spark, g, srs, mode).select("*", F.expr(_size_expr(g, ratio, max_dim)).alias("ps"))
    return box.selectExpr("ulx", "uly", "ps AS pixel_size", *SIZE.split(", "))


def output_size_sql(g: Grid, srs: str, ratio: float = 1.0, max_dim: int | None = None, mode: str = "strict") -> str:
    return f"SELECT ulx, uly, ps AS pixel_size, {SIZE} FROM (SELECT *, {_size_expr(g, ratio, max_dim)} AS ps FROM ({minbox_sql(g, srs, mode)}) b) s"


def output_grid(spark: SparkSession, g: Grid, srs: str, tile_size: int = 256, ratio: float = 1.0, nodata: float | None = None, max_dim: int | None = None, mode: str = "strict") -> Grid:
    """The grid that covers ``g`` in ``srs`` (one aggregated row comes to the driver)."""
    r = output_size(spark, g, srs, ratio, max_dim, mode).first()
    return Grid(srs, r.ulx, r.uly, r.pixel_size, max(1, r.n_rows), max(1, r.n_cols), g.pixel_type, g.n_bands, g.nodata if nodata is None else nodata, tile_size, g.colors)


GRID_COLUMNS = ("ulx", "uly", "pixel_size", "n_rows", "n_cols")


def output_sizes(grids: DataFrame, srs: str, to: str, ratio: float = 1.0, max_dim: int | None = None, mode: str = "strict") -> DataFrame:
    """``output_size`` and its extent for each row of ``grids`` (``GRID_COLUMNS``, all in ``srs``): with the columns
    out_ulx, out_uly, out_lrx, out_lry, out_pixel_size, out_n_rows, out_n_cols; null where no point is inside."""
    if ratio <= 0:
        raise BadArgument("the output ratio must be positive")
    s, t = parse(srs), parse(to)
    made = ["out_ulx", "out_uly", "out_lrx", "out_lry"]
    names = [*grids.columns, *made]

    def box(ulx: float, uly: float, ps: float, rows: int, cols: int) -> tuple[float, ...] | None:
        g, found = Grid(srs, ulx, uly, ps, rows, cols), []
        for r0, r1, c0, c1 in border_bands(g, mode):
            wide = c1 - c0 + 1
            for k in range(0, (r1 - r0 + 1) * wide, STRIP):  # a strip at a time, however large the grid is
                row, col = np.divmod(np.arange(k, min(k + STRIP, (r1 - r0 + 1) * wide)), wide)
                u, v = sphere.forward(t, *sphere.inverse(s, ulx + (col + c0) * ps, uly - (row + r0) * ps))
                ok = np.isfinite(u) & np.isfinite(v)
                if ok.any():
                    found.append((u[ok].min(), v[ok].max(), u[ok].max(), v[ok].min()))
        if not found:
            return None
        low, high = np.min(found, axis=0), np.max(found, axis=0)
        return float(low[0]), float(high[1]), float(high[2]), float(low[3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [box(*x) for x in zip(*(b.column(c).to_pylist() for c in GRID_COLUMNS), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x and x[k] for x in got], pa.float64()) for k in range(4))], names)

    schema = ", ".join([*(f"`{k}` {v}" for k, v in grids.dtypes), *(f"{c} double" for c in made)])
    wide, high = "out_lrx - out_ulx", "out_uly - out_lry"
    size = f"greatest({wide}, {high})/{lit(max_dim)}" if max_dim else f"sqrt(({wide})*({wide}) + ({high})*({high}))/sqrt(CAST(n_rows AS DOUBLE)*n_rows + CAST(n_cols AS DOUBLE)*n_cols)"
    boxes = grids.mapInArrow(run, schema).withColumn("out_pixel_size", F.expr(f"{lit(ratio)}*{size}"))
    cells = lambda d: F.expr(f"CAST(floor(0.5e0 + ({d})/out_pixel_size) AS BIGINT)")
    return boxes.withColumns({"out_n_rows": cells(high), "out_n_cols": cells(wide)})


def block_partitions(grids: DataFrame, tile_size: int, partition_size: int = 1) -> DataFrame:
    """``block_partition`` of each row of ``grids`` (n_rows, n_cols and other columns, which stay): a row for each block, made where
    its grid is."""
    if min(tile_size, partition_size) < 1:
        raise BadArgument("sizes must be positive")
    rest = [c for c in grids.columns if c not in ("n_rows", "n_cols")]
    high = math.isqrt(partition_size)
    h, w = high * tile_size, partition_size // high * tile_size
    ids = grids.select(*rest, "n_rows", "n_cols", F.expr(f"(n_cols + {w - 1}) div {w}").alias("_across"), F.explode(F.expr(f"sequence(0L, (n_rows + {h - 1}) div {h} * ((n_cols + {w - 1}) div {w}) - 1)")).alias("part_id"))
    r, c = "(part_id div _across)", "(part_id % _across)"
    return ids.selectExpr(*rest, "part_id", f"{c}*{w} AS ul_col", f"{r}*{h} AS ul_row", f"least(({c} + 1)*{w}, n_cols) - 1 AS lr_col", f"least(({r} + 1)*{h}, n_rows) - 1 AS lr_row")


def block_partition(spark: SparkSession, n_rows: int, n_cols: int, tile_size: int, partition_size: int = 1, workers: int = 1) -> DataFrame:
    """(part_id, worker, ul_col, ul_row, lr_col, lr_row): blocks of tiles in row-major order,
    inclusive; ``worker`` goes round.  A block is floor(sqrt(p)) tiles high, p div that wide."""
    if min(n_rows, n_cols, tile_size, partition_size, workers) < 1:
        raise BadArgument("sizes must be positive")
    high = math.isqrt(partition_size)
    h, w = high * tile_size, partition_size // high * tile_size
    down, across = -(-n_rows // h), -(-n_cols // w)
    ids = spark.range(down * across).selectExpr("id AS part_id", f"id % {workers} AS worker", f"id div {across} AS r", f"id % {across} AS c")
    return ids.selectExpr("part_id", "worker", f"c*{w} AS ul_col", f"r*{h} AS ul_row", f"least((c + 1)*{w}, {n_cols}) - 1 AS lr_col", f"least((r + 1)*{h}, {n_rows}) - 1 AS lr_row")


def block_partition_sql(n_rows: int, n_cols: int, tile_size: int, partition_size: int = 1, workers: int = 1) -> str:
    high = math.isqrt(partition_size)
    h, w = high * tile_size, partition_size // high * tile_size
    down, across = -(-n_rows // h), -(-n_cols // w)
    return f"SELECT r*{across} + c AS part_id, (r*{across} + c) % {workers} AS worker, c*{w} AS ul_col, r*{h} AS ul_row, least((c + 1)*{w}, {n_cols}) - 1 AS lr_col, least((r + 1)*{h}, {n_rows}) - 1 AS lr_row FROM range(0, {down}) a(r), range(0, {across}) b(c)"


def raster_minbox(parts: DataFrame, grid_from: Grid, grid_to: Grid) -> DataFrame:
    """(part_id, ul_col, ul_row, lr_col, lr_row): for each block of ``grid_from`` the box of
    ``grid_to`` that its cells need; blocks wholly outside have no row.  Small blocks are mapped
    together, large ones in bands of rows, whose boxes are merged."""

    def boxes(blocks: np.ndarray) -> np.ndarray:
        """[part_id, box] of blocks [part_id, ul_col, ul_row, lr_col, lr_row], all their cells at once."""
        wide = blocks[:, 3] - blocks[:, 1] + 1
        n = wide * (blocks[:, 4] - blocks[:, 2] + 1)
        of = np.repeat(np.arange(len(blocks)), n)
        row, col = np.divmod(np.arange(of.size) - np.repeat(np.cumsum(n) - n, n), wide[of])
        ok, *found = rectangles(grid_from, grid_to, row + blocks[of, 2], col + blocks[of, 1])
        c0, r0, c1, r1 = found
        ok &= (c0 < grid_to.n_cols) & (r0 < grid_to.n_rows) & (c1 < grid_to.n_cols) & (r1 < grid_to.n_rows)
        of = of[ok]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if of.size else of
        low, high = (f.reduceat(np.stack(found, axis=1)[ok], first) if of.size else np.zeros((0, 4), np.int64) for f in (np.minimum, np.maximum))
        return np.column_stack([blocks[of[first], 0], low[:, :2], high[:, 2:]])

    def pieces(blocks: np.ndarray) -> Iterator[np.ndarray]:
        """Runs of blocks that have about STRIP cells; a larger block is cut into bands of rows."""
        n = (blocks[:, 3] - blocks[:, 1] + 1) * (blocks[:, 4] - blocks[:, 2] + 1)
        total, at = np.cumsum(n), 0
        while at < len(blocks):
            end = max(at + 1, int(np.searchsorted(total, total[at] - n[at] + STRIP, "right")))
            if n[at] <= STRIP:
                yield blocks[at:end]
            else:
                end = at + 1
                part, left, top, right, bottom = (int(x) for x in blocks[at])
                step = max(1, STRIP // (right - left + 1))
                for r in range(top, bottom + 1, step):
                    yield np.array([[part, left, r, right, min(bottom, r + step - 1)]])
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = np.stack([b.column(c).to_numpy() for c in ("part_id", "ul_col", "ul_row", "lr_col", "lr_row")], axis=1)
            for piece in pieces(blocks):
                got = boxes(piece)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got.T], ["part_id", "ul_col", "ul_row", "lr_col", "lr_row"])

    every = parts.select(F.col("part_id").cast("long"), *[F.col(c).cast("long") for c in ("ul_col", "ul_row", "lr_col", "lr_row")])
    found = every.mapInArrow(run, "part_id long, ul_col long, ul_row long, lr_col long, lr_row long")
    return found.groupBy("part_id").agg(F.min("ul_col").alias("ul_col"), F.min("ul_row").alias("ul_row"), F.max("lr_col").alias("lr_col"), F.max("lr_row").alias("lr_row"))
