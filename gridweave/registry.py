"""Queries over grids made from the tables, and the SQL that states them."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry_systems as systems
from .functions import kernels
from .functions.projections import forward, inverse
from .model import Grid, Resampler, cell_type
from .operators import geometry as geo
from .operators import reproject as rp
from .operators import tilewise as tw
from .operators import tiles as tl

GLOBE = Grid("+proj=longlat", -180.0, 90.0, 5.625, 32, 64, "Float64")
PLANE_COLS = 50  # columns of the grid made from orders
CELL = 20_000.0
PROJECTIONS = ("sinu", "cea", "merc", "mill", "gall", "gnom", "laea", "aea", "vandg")
PARAMETER = ("moll", "eck4", "eck6")
Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def globe_pixels(s: SparkSession, d: str) -> DataFrame:
    """Global 32 x 64 grids from the vectors, 32 vectors a grid: the last one may have fewer rows."""
    each = _read(s, d, "embeddings").select(F.expr("vec_id div 32").alias("raster_id"), (F.col("vec_id") % 32).cast("int").alias("row"), F.posexplode("embedding").alias("col", "value"))
    return each.withColumn("value", F.col("value").cast("double"))


GLOBE_SQL = "SELECT vec_id // 32 AS raster_id, vec_id % 32 AS row, c AS col, CAST(embedding[c + 1] AS DOUBLE) AS value FROM embeddings, range(0, 64) r(c)"


PLANE = Grid("+proj=cea", -PLANE_COLS * CELL / 2, 5_000_000.0, CELL, 30, PLANE_COLS, "Float64")


def plane_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Grids of 30 x 50 orders' prices, in metres."""
    at = f"o_orderkey div {PLANE_COLS}"
    return _read(spark, d, "orders").selectExpr(f"({at}) div 30 AS raster_id", f"CAST(({at}) % 30 AS INT) AS row", f"CAST(o_orderkey % {PLANE_COLS} AS INT) AS col", "o_totalprice AS value")


PLANE_SQL = "SELECT o_orderkey // 50 // 30 AS raster_id, o_orderkey // 50 % 30 AS row, o_orderkey % 50 AS col, o_totalprice AS value FROM orders"


def _out_sql(cells_of: str, src: Grid, fill: float, agg: str | None, support: int = 0, weight: str = "1e0", pixels: str = GLOBE_SQL, dst: Grid | None = None) -> str:
    """A reprojection as SQL; ``cells_of`` is a query of the output's cells, ``dst`` its grid."""
    m = geo.pixel_map_sql(cells_of, dst, src, support)
    rect = f"SELECT row AS dst_row, col AS dst_col, ul_col, ul_row, least(lr_col, {src.n_cols - 1}) AS lr_col, lr_row FROM ({m}) m WHERE valid AND ul_col <= {src.n_cols - 1} AND lr_row <= {src.n_rows - 1}"
    if agg is None:
        got = "SELECT p.raster_id, r.dst_row, r.dst_col, p.value FROM rect r JOIN pixels p ON p.row = r.ul_row AND p.col = r.ul_col"
    else:
        got = f"SELECT raster_id, dst_row, dst_col, {agg} AS value FROM (SELECT *, {weight} AS w FROM (SELECT p.raster_id, p.row, p.col, p.value, r.dst_row, r.dst_col, r.ul_col, r.ul_row, r.lr_col, r.lr_row FROM rect r JOIN pixels p ON p.row BETWEEN r.ul_row AND r.lr_row AND p.col BETWEEN r.ul_col AND r.lr_col) j) k GROUP BY 1, 2, 3"
    return f"WITH pixels AS ({pixels}), rect AS ({rect}), got AS ({got}) SELECT i.raster_id, c.row, c.col, round(coalesce(g.value, {fill}), 6) AS value FROM (SELECT DISTINCT raster_id FROM pixels) i CROSS JOIN ({cells_of}) c LEFT JOIN got g ON g.raster_id = i.raster_id AND g.dst_row = c.row AND g.dst_col = c.col"


AGG = {"nearest": None, "min": "min(value)", "max": "max(value)", "mean": "avg(value)"}


def fixed_output(proj: str) -> Grid:
    """Output grids whose cell borders avoid those of the source; sizing has queries of its own."""
    span = {"sinu": (-20015077.3, 10007538.6), "cea": (-20015077.3, 6370990.1), "merc": (-20015077.3, 15000011.7)}[proj]
    ps = 625471.1
    return Grid(f"+proj={proj}", span[0], span[1], ps, int(2 * span[1] / ps), 64, "Float64")


def _cells_sql(g: Grid) -> str:
    return f"SELECT r AS row, c AS col FROM range(0, {g.n_rows}) a(r), range(0, {g.n_cols}) b(c)"


PLANE_OUT = Grid("+proj=sinu", PLANE.ulx + 3333.3, 5_555_777.7, 34_567.8, 17, 27, "Float64")


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    for r in AGG:
        for proj in ("sinu", "merc", "cea"):
            q[f"reproject_{r}_{proj}"] = lambda s, d, r=r, p=proj: rp.reproject(globe_pixels(s, d), GLOBE, fixed_output(p), r).withColumn("value", F.round("value", 6))
    for r in kernels.KERNELS:
        q[f"reproject_{r}"] = lambda s, d, r=r: rp.reproject(plane_pixels(s, d), PLANE, PLANE_OUT, r).withColumn("value", F.round("value", 4))
    q["reproject_sized_sinu"] = lambda s, d: rp.reproject(globe_pixels(s, d), GLOBE, geo.output_grid(s, GLOBE, "+proj=sinu"))
    for proj in (*PROJECTIONS, *PARAMETER):
        q[f"proj_{proj}_fwd"] = lambda s, d, p=proj: geo.transform_points(_points(s, d), p, "lam", "phi", ("x", "y")).selectExpr("id", "round(x, 3) AS x", "round(y, 3) AS y")
        q[f"proj_{proj}_roundtrip"] = _roundtrip(proj)
    q["cell_to_projected"] = lambda s, d: _order_cells(s, d).selectExpr("id", "row", "col", *[f"{v} AS {k}" for k, v in zip("xy", geo.to_projected(PLANE), strict=True)])
    q["projected_to_cell"] = lambda s, d: _points(s, d).selectExpr("id", *[f"round({v}, 9) AS {k}" for k, v in zip(("col", "row"), geo.to_raster(GLOBE, "degrees(lam)", "degrees(phi)"), strict=True)])
    for mode in ("strict", "corrected"):
        q[f"projected_minbox_{mode}"] = lambda s, d, m=mode: geo.output_sizes(_supplier_grids(s, d), "+proj=longlat", "+proj=sinu +lon_0=30", mode=m).selectExpr("id", *[f"round(out_{c}, 3) AS {c}" for c in ("ulx", "uly", "lrx", "lry")])
    size = ["id", "round(out_ulx, 3) AS ulx", "round(out_uly, 3) AS uly", "round(out_pixel_size, 3) AS pixel_size", "out_n_rows AS n_rows", "out_n_cols AS n_cols"]
    q["output_size_diag"] = lambda s, d: geo.output_sizes(_supplier_grids(s, d), "+proj=longlat", "+proj=sinu +lon_0=30").selectExpr(*size)
    q["output_size_maxdim"] = lambda s, d: geo.output_sizes(_supplier_grids(s, d), "+proj=longlat", "+proj=cea", max_dim=100).selectExpr(*size)
    for name, (factor, ts, ps) in BLOCKS.items():
        q[f"block_partition_{name}"] = lambda s, d, f=factor, t=ts, p=ps: geo.block_partitions(_read(s, d, "part").selectExpr("p_partkey AS id", f"p_size*{f}L + p_partkey % 7 AS n_rows", f"(p_partkey % 40 + 1)*{f}L AS n_cols"), t, p)
    q["pixel_map_sinu"] = lambda s, d: geo.pixel_map(_order_cells(s, d, fixed_output("sinu")), fixed_output("sinu"), GLOBE)
    q["raster_minbox_per_block"] = lambda s, d: geo.raster_minbox(_part_areas(s, d).withColumnRenamed("id", "part_id"), fixed_output("sinu"), GLOBE)
    q["kernel_values"] = lambda s, d: _read(s, d, "part").selectExpr("p_partkey AS id", *[f"round({k('((p_size - 25)/8e0)')}, 9) + 0e0 AS {n}" for n, k in kernels.KERNELS.items()])
    q["mean_wraparound_u8"] = lambda s, d: rp.wrapping_mean(_read(s, d, "part").selectExpr("p_partkey div 10 AS cell", "p_size*5 AS value"), ["cell"], cell_type("Byte"))
    q["rasterize_counts_u16"] = lambda s, d: _read(s, d, "lineitem").groupBy((F.col("l_orderkey") % 60).alias("row"), (F.col("l_suppkey") % 50).alias("col")).agg(F.count(F.lit(1)).alias("value"))
    q["tile_split"] = lambda s, d: tl.split_area(_part_areas(s, d), 16).selectExpr("id", "tile_row", "tile_col", "ul_col", "ul_row", "lr_col", "lr_row")
    q["tile_file_offset"] = lambda s, d: _order_cells(s, d, TILED).select("id", tl.cell_offset(TILED, F.col("row").cast("long"), F.col("col").cast("long"), 1000).alias("offset"))
    q["tile_roundtrip"] = lambda s, d: tl.to_pixels(tl.to_tiles(_padded(globe_pixels(s, d)), Grid("", 0, 0, 1, 32, 64, tile_size=16))).where("value is not null")
    q["raster_compare_badpixels"] = lambda s, d: rp.compare(globe_pixels(s, d), globe_pixels(s, d).withColumn("value", F.expr("value + CASE WHEN (row + col) % 7 = 0 THEN 0.01e0 ELSE 0.0005e0 END")))
    q["timing_summary"] = lambda s, d: rp.timing_summary(_timing(s, d)).selectExpr(*[f"round({c}, 6) AS {c}" for c in rp.TIMES])
    q["geotiff_roundtrip"] = geotiff_roundtrip
    # the same tile by tile
    for r in AGG:
        for proj in ("sinu", "merc", "cea"):
            q[f"reproject_{r}_{proj}_all"] = lambda s, d, r=r, p=proj: _by_tiles(s, d, Resampler(r), fixed_output(p)).withColumn("value", F.round("value", 6))
    q["reproject_sized_sinu_all"] = lambda s, d: _by_tiles(s, d, Resampler.NEAREST, geo.output_grid(s, GLOBE, "+proj=sinu"))
    q["tile_roundtrip_all"] = lambda s, d: tl.to_pixels(tl.to_tiles(_padded(globe_pixels(s, d)), Grid("", 0, 0, 1, 32, 64, tile_size=10))).where("value is not null")
    q["raster_compare_badpixels_all"] = lambda s, d: rp.compare(globe_pixels(s, d), globe_pixels(s, d).withColumn("value", F.expr("value + CASE WHEN (row + col) % 7 = 0 THEN 0.01e0 ELSE 0.0005e0 END")))
    q["geotiff_roundtrip_all"] = geotiff_roundtrip_all
    q["geotiff_strips_roundtrip"] = lambda s, d: geotiff_roundtrip(s, d, "strip")
    q["tile_store_window"] = store_window
    q["raster_compare_files"] = compare_files
    q["downsample_mean_cea"] = downsample
    for r in (Resampler.NEAREST, Resampler.MIN, Resampler.MAX, Resampler.MEAN):
        q[f"reproject_file_{r.value}_sinu"] = lambda s, d, r=r: reproject_file(s, d, r)
    q |= systems.queries()
    for r in Resampler:
        q[f"reproject_tiles_{r.value}"] = lambda s, d, r=r: tiles_of(s, d, r)
    return q


TILED_GLOBE = replace(GLOBE, tile_size=10)


def tiles_of(s: SparkSession, d: str, r: Resampler) -> DataFrame:
    """Reprojections tile by tile: of the vectors, or of the orders for weighted resamplers."""
    if r.support:
        src, dst = replace(PLANE, tile_size=16), replace(PLANE_OUT, tile_size=8)
        out = tw.reproject_tiles(tl.to_tiles(plane_pixels(s, d), src), src, dst, r, rasters=_read(s, d, "orders").selectExpr("o_orderkey div 1500 AS raster_id").distinct())
        return tl.to_pixels(out).withColumn("value", F.round("value", 4))
    return _by_tiles(s, d, r, fixed_output("sinu")).withColumn("value", F.round("value", 6))


def _by_tiles(s: SparkSession, d: str, r: Resampler, dst: Grid) -> DataFrame:
    tiles = tl.to_tiles(_padded(globe_pixels(s, d)), TILED_GLOBE)
    rasters = _read(s, d, "embeddings").selectExpr("vec_id div 32 AS raster_id").distinct()
    return tl.to_pixels(tw.reproject_tiles(tiles, TILED_GLOBE, replace(dst, tile_size=8), r, rasters=rasters))


def sized_sinu() -> Grid:
    """The grid of ``reproject_sized_sinu``, from the corners that are scanned, one by one."""
    corners = [(row, col) for row in range(32) for col in range(64) if row >= 21 or col <= 10 or col >= 53]
    at = [(6370997.0 * math.radians(col * 5.625 - 180) * math.cos(math.radians(90 - row * 5.625)), 6370997.0 * math.radians(90 - row * 5.625)) for row, col in corners]
    left, right, low, high = min(x for x, _ in at), max(x for x, _ in at), min(y for _, y in at), max(y for _, y in at)
    ps = math.hypot(right - left, high - low) / math.hypot(32, 64)
    return Grid("+proj=sinu", left, high, ps, int(0.5 + (high - low) / ps), int(0.5 + (right - left) / ps))


# Newton's steps for three projections, in SQL of their own: the step and x and y of the angle t
NEWTON = {
    "moll": ("(2*t + sin(2*t) - pi()*sin(phi))/(2 + 2*cos(2*t))", "0.9e0*phi", "2*sqrt(2e0)/pi()*lam*cos(t)", "sqrt(2e0)*sin(t)"),
    "eck4": ("(t + sin(t)*cos(t) + 2*sin(t) - (2 + pi()/2)*sin(phi))/(2*cos(t)*(1 + cos(t)))", "phi/2", "2*lam*(1 + cos(t))/sqrt(pi()*(4 + pi()))", "2*sqrt(pi()/(4 + pi()))*sin(t)"),
    "eck6": ("(t + sin(t) - (1 + pi()/2)*sin(phi))/(1 + cos(t))", "0.9e0*phi", "lam*(1 + cos(t))/sqrt(2 + pi())", "2*t/sqrt(2 + pi())"),
}


def newton_sql(proj: str) -> str:
    step, start, x, y = NEWTON[proj]
    sql = f"SELECT id, lam, phi, {start} AS t FROM ({POINTS}) p"
    for _ in range(20):
        sql = f"SELECT id, lam, phi, t - {step} AS t FROM ({sql}) n"
    return f"SELECT id, round(6370997e0*{x}, 3) AS x, round(6370997e0*{y}, 3) AS y FROM ({sql}) n"


BLOCKS = {"small": (10, 64, 1), "big": (1000, 1024, 6), "huge": (4000, 1024, 50)}  # cells a unit of the tables' sizes, tile size, tiles in a block
TILED = Grid("", 0, 0, 1, 40, 50, "UInt16", tile_size=16)
POINTS = "SELECT c_custkey AS id, radians((c_custkey*37 % 3400)/10e0 - 170e0) AS lam, radians((c_custkey*53 % 1600)/10e0 - 80e0) AS phi FROM customer"


#: Areas of the 64-column sinusoidal grid, from parts, inclusive.
PART_AREAS = "p_partkey AS id, p_partkey*7 % 50 AS ul_col, p_partkey*3 % 20 AS ul_row, p_partkey*7 % 50 + p_size % 14 AS lr_col, p_partkey*3 % 20 + p_size % 12 AS lr_row"
#: Geographic grids of some degrees, from suppliers.
SUPPLIER_GRIDS = "s_suppkey AS id, (s_suppkey*37 % 1200)/10e0 - 80e0 AS ulx, (s_suppkey*53 % 1100)/10e0 - 30e0 AS uly, 0.25e0 + (s_suppkey % 5)/8e0 AS pixel_size, 5 + s_suppkey % 41 AS n_rows, 7 + s_suppkey % 53 AS n_cols"


def _part_areas(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "part").selectExpr(*PART_AREAS.split(", "))


def _supplier_grids(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "supplier").selectExpr(*SUPPLIER_GRIDS.split(", "))


def _order_cells(s: SparkSession, d: str, g: Grid = PLANE) -> DataFrame:
    return _read(s, d, "orders").selectExpr("o_orderkey AS id", f"CAST(o_orderkey div {g.n_cols} % {g.n_rows} AS INT) AS row", f"CAST(o_orderkey % {g.n_cols} AS INT) AS col")


def _order_cells_sql(g: Grid = PLANE) -> str:
    return f"SELECT o_orderkey AS id, o_orderkey // {g.n_cols} % {g.n_rows} AS row, o_orderkey % {g.n_cols} AS col FROM orders"


def _extents_sql(mode: str, x: str, y: str, columns: str, size: str = "0e0") -> str:
    """Extents of the suppliers' grids: every corner that is scanned, on its own; ``x``, ``y`` of lam and phi."""
    rb, cb = "least(10, n_rows)", "least(10, n_cols)"
    if mode == "strict":
        scanned, edge = f"(r >= n_rows - {rb} - 1 AND c BETWEEN 0 AND n_cols - 1 OR r >= 0 AND (c BETWEEN 0 AND {cb} OR c BETWEEN n_cols - {cb} - 1 AND n_cols - 1)) AND r < n_rows", ""
    else:
        scanned, edge = f"r BETWEEN 0 AND n_rows AND c BETWEEN 0 AND n_cols AND (r <= {rb} OR r >= n_rows - {rb} OR c <= {cb} OR c >= n_cols - {cb})", ""
    points = f"SELECT id, n_rows, n_cols, radians(ulx + c*pixel_size) AS lam, radians(uly - r*pixel_size) AS phi FROM (SELECT {SUPPLIER_GRIDS} FROM supplier) g, range(-1, 60) a(r), range(-1, 72) b(c) WHERE {scanned}{edge}"
    boxes = f"SELECT id, any_value(n_rows) AS rows, any_value(n_cols) AS cols, min({x}) AS ulx, max({y}) AS uly, max({x}) AS lrx, min({y}) AS lry FROM ({points}) p GROUP BY id"
    return f"SELECT id, {columns} FROM (SELECT *, {size} AS ps FROM ({boxes}) b) s"


def _points(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "customer").selectExpr("c_custkey AS id", "radians((c_custkey*37 % 3400)/10e0 - 170e0) AS lam", "radians((c_custkey*53 % 1600)/10e0 - 80e0) AS phi")


def _back(proj: str) -> list[dict[str, str]]:
    return [dict(zip(("x", "y"), forward(proj, "lam", "phi"), strict=True)), dict(zip(("lam2", "phi2"), inverse(proj, "x", "y"), strict=True))]


#: Points that come back, and those that are inside the projection's domain at all.
ROUNDTRIP = ("coalesce(abs(lam2 - lam) < 1e-6 AND abs(phi2 - phi) < 1e-6, false) AS same", "x IS NOT NULL AS inside")


def _roundtrip(proj: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        there = geo.transform_points(_points(s, d), proj, "lam", "phi", ("x", "y"))
        return geo.transform_points(there, proj, "x", "y", ("lam2", "phi2"), back=True).selectExpr("id", *ROUNDTRIP)

    return query


def _timing(s: SparkSession, d: str) -> DataFrame:
    e = _read(s, d, "events")
    return e.groupBy((F.col("user_id") % 8).alias("process")).agg(*[F.sum(F.col("value") * (i + 1)).alias(c) for i, c in enumerate(rp.TIMES)])


def _path(s: SparkSession, name: str) -> str:
    """A new place in the folder that all machines share; on this machine alone, where none is named."""
    import tempfile

    found = s.sparkContext.getConf().get("spark.checkpoint.dir") or s.conf.get("spark.checkpoint.dir", None)
    if not found and not s.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{(found or tempfile.mkdtemp(prefix='gridweave-')).removeprefix('file://')}/{name}-{uuid.uuid4().hex}"


def _padded(pixels: DataFrame) -> DataFrame:
    """All 32 x 64 cells of each grid, null where it has none: tiles are whole then."""
    whole = pixels.select("raster_id").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(31)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return whole.join(pixels, ["raster_id", "row", "col"], "left")


def _bands_file(s: SparkSession, d: str, tile_size: int, layout: str) -> tuple[str, Grid]:
    """All grids as the bands of one file; cells that the last one lacks are NaN, the nodata value."""
    from .sources.bigtiff import register, write_grid

    register(s)
    n = _read(s, d, "embeddings").agg(F.max("vec_id")).first()[0] // 32 + 1
    g = replace(GLOBE, n_bands=n, nodata=math.nan, tile_size=tile_size)
    path = f"{_path(s, 'bands')}.tif"
    bands = _padded(globe_pixels(s, d)).select((F.col("raster_id") + 1).cast("int").alias("band"), "row", "col", "value")
    write_grid(tl.to_tiles(bands, g), g, path, layout)
    return path, g


def geotiff_roundtrip(s: SparkSession, d: str, layout: str = "tile") -> DataFrame:
    """All grids as bands of one file, in tiles or strips, read again."""
    path, g = _bands_file(s, d, 16, layout)
    back = tl.to_pixels(s.read.format("gridtiff").option("tilesize", g.tile_size).load(path))
    return back.where("NOT isnan(value)").selectExpr("CAST(band - 1 AS BIGINT) AS raster_id", "row", "col", "value")


def geotiff_roundtrip_all(s: SparkSession, d: str) -> DataFrame:
    """All grids, one below the other, written as one tiled file and read again."""
    from .sources.bigtiff import register, write_grid

    register(s)
    rows = _read(s, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    g = Grid("+proj=longlat", -180.0, 90.0, 5.625, rows, 64, "Float64", tile_size=64)
    path = f"{_path(s, 'tall')}.tif"
    write_grid(tl.to_tiles(globe_pixels(s, d).selectExpr("CAST(raster_id * 32 + row AS INT) AS row", "col", "value"), g), g, path)
    return tl.to_pixels(s.read.format("gridtiff").option("tilesPerPartition", 256).load(path)).selectExpr("CAST(row div 32 AS BIGINT) AS raster_id", "row % 32 AS row", "col", "value")


def reproject_file(s: SparkSession, d: str, r: Resampler) -> DataFrame:
    """The file of bands, reprojected straight from the file."""
    path, g = _bands_file(s, d, 16, "tile")
    out = tw.reproject_file(s, path, g, replace(fixed_output("sinu"), n_bands=g.n_bands, tile_size=8), r)
    return tl.to_pixels(out).selectExpr("CAST(band - 1 AS BIGINT) AS raster_id", "row", "col", "round(value, 6) AS value")


#: One output tile over all cells of a grid of orders, whose tiles are small: many source tiles for each output cell.
COARSE = Grid("+proj=cea", PLANE.ulx - 1_111.1, PLANE.uly + 1_111.1, 7 * CELL, 4, 7, "Float64", tile_size=8)


def downsample(s: SparkSession, d: str) -> DataFrame:
    src = replace(PLANE, tile_size=3)
    out = tw.reproject_tiles(tl.to_tiles(plane_pixels(s, d), src), src, COARSE, Resampler.MEAN, rasters=_read(s, d, "orders").selectExpr("o_orderkey div 1500 AS raster_id").distinct())
    return tl.to_pixels(out).withColumn("value", F.round("value", 4))


#: Cells of the window that is read from the store: top, left, bottom, right.
WINDOW = (5, 20, 17, 43)


def store_window(s: SparkSession, d: str) -> DataFrame:
    """A window of all grids from a store of tiles."""
    from .sources import store

    path = _path(s, "store")
    store.write_store(tl.to_tiles(_padded(globe_pixels(s, d)), replace(GLOBE, tile_size=8)), path)
    return store.window_cells(store.read_window(s, path, 8, *WINDOW), *WINDOW).where("value is not null")


def compare_files(s: SparkSession, d: str) -> DataFrame:
    """Cells that differ between the file of bands, in strips, and one in tiles whose every 7th cell is moved."""
    from .plans.compare import differences
    from .sources.bigtiff import write_grid

    path, g = _bands_file(s, d, 16, "strip")
    other = f"{_path(s, 'moved')}.tif"
    moved = _padded(globe_pixels(s, d)).select((F.col("raster_id") + 1).cast("int").alias("band"), "row", "col", F.expr("value + CASE WHEN (row + col) % 7 = 0 THEN 0.01e0 ELSE 0.0005e0 END").alias("value"))
    write_grid(tl.to_tiles(moved, g), g, other)
    return differences(s, path, other).selectExpr("CAST(band - 1 AS BIGINT) AS raster_id", "row", "col", "round(a, 6) AS a", "round(b, 6) AS b")


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    for r, agg in AGG.items():
        for proj in ("sinu", "merc", "cea"):
            g = fixed_output(proj)
            q[f"reproject_{r}_{proj}"] = _out_sql(_cells_sql(g), GLOBE, 0.0, agg, dst=g)
    for r, kernel in kernels.KERNELS.items():
        support = Resampler(r).support
        weight = rp.weight_sql(kernel, support, PLANE, PLANE_OUT)
        q[f"reproject_{r}"] = _out_sql(_cells_sql(PLANE_OUT), PLANE, 0.0, "sum(w*value)/nullif(sum(w), 0e0)", support, weight, PLANE_SQL, PLANE_OUT).replace(", 6) AS value", ", 4) AS value")
    for proj in PROJECTIONS:
        x, y = forward(proj, "lam", "phi")
        q[f"proj_{proj}_fwd"] = f"SELECT id, round({x}, 3) AS x, round({y}, 3) AS y FROM ({POINTS}) p"
        first, second = _back(proj)
        sql = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in first.items())} FROM ({POINTS}) p"
        q[f"proj_{proj}_roundtrip"] = f"SELECT id, {', '.join(ROUNDTRIP)} FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in second.items())} FROM ({sql}) q) r"
    q["cell_to_projected"] = f"SELECT id, row, col, -500000e0 + col*20000e0 AS x, 5000000e0 - row*20000e0 AS y FROM ({_order_cells_sql()}) c"
    q["projected_to_cell"] = f"SELECT id, round((degrees(lam) + 180e0)/5.625e0, 9) AS col, round((90e0 - degrees(phi))/5.625e0, 9) AS row FROM ({POINTS}) p"
    sinu = ("6370997e0*(lam - radians(30e0))*cos(phi)", "6370997e0*phi")
    for mode in ("strict", "corrected"):
        q[f"projected_minbox_{mode}"] = _extents_sql(mode, *sinu, ", ".join(f"round({c}, 3) AS {c}" for c in ("ulx", "uly", "lrx", "lry")))
    size = "round(ulx, 3) AS ulx, round(uly, 3) AS uly, round(ps, 3) AS pixel_size, CAST(floor(0.5e0 + (uly - lry)/ps) AS BIGINT) AS n_rows, CAST(floor(0.5e0 + (lrx - ulx)/ps) AS BIGINT) AS n_cols"
    q["output_size_diag"] = _extents_sql("strict", *sinu, size, "sqrt((lrx - ulx)*(lrx - ulx) + (uly - lry)*(uly - lry))/sqrt(CAST(rows*rows + cols*cols AS DOUBLE))")
    q["output_size_maxdim"] = _extents_sql("strict", "6370997e0*lam", "6370997e0*sin(phi)", size, "greatest(lrx - ulx, uly - lry)/100e0")
    for name, (factor, ts, ps) in BLOCKS.items():
        h = int(ps**0.5)
        high, wide = h * ts, ps // h * ts
        q[f"block_partition_{name}"] = f"SELECT id, r*((n_cols + {wide} - 1) // {wide}) + c AS part_id, c*{wide} AS ul_col, r*{high} AS ul_row, least(c*{wide} + {wide}, n_cols) - 1 AS lr_col, least(r*{high} + {high}, n_rows) - 1 AS lr_row FROM (SELECT p_partkey AS id, p_size*{factor} + p_partkey % 7 AS n_rows, (p_partkey % 40 + 1)*{factor} AS n_cols FROM part) g, range(0, 500) a(r), range(0, 500) b(c) WHERE r*{high} < n_rows AND c*{wide} < n_cols"
    g = fixed_output("sinu")
    q["pixel_map_sinu"] = f"SELECT id, row, col, {', '.join(geo.MAP)} FROM ({geo.pixel_map_sql(_order_cells_sql(g), g, GLOBE)}) m"
    q["raster_minbox_per_block"] = f"SELECT id AS part_id, min(m.ul_col) AS ul_col, min(m.ul_row) AS ul_row, max(m.lr_col) AS lr_col, max(m.lr_row) AS lr_row FROM ({geo.pixel_map_sql(_cells_sql(g), g, GLOBE)}) m JOIN (SELECT {PART_AREAS} FROM part) b ON m.row BETWEEN b.ul_row AND b.lr_row AND m.col BETWEEN b.ul_col AND b.lr_col WHERE valid AND m.ul_col <= 63 AND m.ul_row <= 31 AND m.lr_col <= 63 AND m.lr_row <= 31 GROUP BY 1"
    x = "abs((p_size - 25)/8e0)"
    sinc = lambda v: f"CASE WHEN {v} = 0 THEN 1e0 ELSE sin(pi()*{v})/(pi()*nullif({v}, 0)) END"
    q["kernel_values"] = f"SELECT p_partkey AS id, round(CASE WHEN {x} < 1 THEN 1 - {x} ELSE 0 END, 9) + 0e0 AS bilinear, round(CASE WHEN {x} < 1 THEN 1.5e0*pow({x}, 3) - 2.5e0*pow({x}, 2) + 1 WHEN {x} < 2 THEN -0.5e0*pow({x}, 3) + 2.5e0*pow({x}, 2) - 4*{x} + 2 ELSE 0 END, 9) + 0e0 AS bicubic, round(CASE WHEN {x} <= 3 THEN ({sinc(x)})*({sinc(f'({x}/3)')}) ELSE 0 END, 9) + 0e0 AS lanczos FROM part"
    q["mean_wraparound_u8"] = "SELECT p_partkey // 10 AS cell, (sum(p_size*5) % 256) // count(*) AS value FROM part GROUP BY 1"
    q["rasterize_counts_u16"] = "SELECT l_orderkey % 60 AS row, l_suppkey % 50 AS col, count(*) AS value FROM lineitem GROUP BY 1, 2"
    q["tile_split"] = f"SELECT id, t AS tile_row, u AS tile_col, greatest(ul_col, u*16) AS ul_col, greatest(ul_row, t*16) AS ul_row, least(lr_col, u*16 + 15) AS lr_col, least(lr_row, t*16 + 15) AS lr_row FROM (SELECT {PART_AREAS} FROM part) b JOIN range(0, 7) x(t) ON t BETWEEN ul_row // 16 AND lr_row // 16 JOIN range(0, 9) y(u) ON u BETWEEN ul_col // 16 AND lr_col // 16"
    q["tile_file_offset"] = f"SELECT id, 1000 + (row // 16*4 + col // 16)*512 + (col % 16 + row % 16*16)*2 AS \"offset\" FROM ({_order_cells_sql(TILED)}) c"
    q["tile_roundtrip"] = GLOBE_SQL
    q["geotiff_roundtrip"] = q["geotiff_strips_roundtrip"] = GLOBE_SQL
    q["tile_store_window"] = f"SELECT * FROM ({GLOBE_SQL}) p WHERE row BETWEEN {WINDOW[0]} AND {WINDOW[2]} AND col BETWEEN {WINDOW[1]} AND {WINDOW[3]}"
    q["raster_compare_files"] = f"SELECT raster_id, row, col, round(value, 6) AS a, round(value + 0.01e0, 6) AS b FROM ({GLOBE_SQL}) p WHERE (row + col) % 7 = 0"
    q["downsample_mean_cea"] = _out_sql(_cells_sql(COARSE), PLANE, 0.0, "avg(value)", pixels=PLANE_SQL, dst=COARSE).replace(", 6) AS value", ", 4) AS value")
    q["raster_compare_badpixels"] = f"SELECT count(*) AS n_cells, 0 AS n_missing, count(*) FILTER ((row + col) % 7 = 0) AS n_bad FROM ({GLOBE_SQL}) p"
    for r, agg in AGG.items():
        for proj in ("sinu", "merc", "cea"):
            g = fixed_output(proj)
            q[f"reproject_{r}_{proj}_all"] = _out_sql(_cells_sql(g), GLOBE, 0.0, agg, pixels=GLOBE_SQL, dst=g)
    q["tile_roundtrip_all"] = q["geotiff_roundtrip_all"] = GLOBE_SQL
    for r in AGG:
        q[f"reproject_file_{r}_sinu"] = q[f"reproject_{r}_sinu_all"]
    q |= systems.oracle_sql()
    for r in Resampler:
        q[f"reproject_tiles_{r.value}"] = q[f"reproject_{r.value}"] if r.support else q[f"reproject_{r.value}_sinu_all"]
    g = sized_sinu()
    for name, pixels in (("reproject_sized_sinu", GLOBE_SQL), ("reproject_sized_sinu_all", GLOBE_SQL)):
        q[name] = _out_sql(_cells_sql(g), GLOBE, 0.0, None, pixels=pixels, dst=g).replace("round(coalesce(g.value, 0.0), 6)", "coalesce(g.value, 0e0)")
    for proj in PARAMETER:
        q[f"proj_{proj}_fwd"] = newton_sql(proj)
        q[f"proj_{proj}_roundtrip"] = f"SELECT id, true AS same, true AS inside FROM ({POINTS}) p"  # by definition, all of the globe being inside
    q["raster_compare_badpixels_all"] = f"SELECT count(*) AS n_cells, 0 AS n_missing, count(*) FILTER ((row + col) % 7 = 0) AS n_bad FROM ({GLOBE_SQL}) p"
    times = ", ".join(f"round(avg({c}), 6) AS {c}" for c in rp.TIMES)
    sums = ", ".join(f"sum(value*{i + 1}) AS {c}" for i, c in enumerate(rp.TIMES))
    q["timing_summary"] = f"SELECT {times} FROM (SELECT user_id % 8 AS process, {sums} FROM events GROUP BY 1) t"
    return q
