"""Cells and tiles, and the place of a cell in a tiled file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Grid, cell_type


def to_tiles(pixels: DataFrame, g: Grid) -> DataFrame:
    """(keys, tile_row, tile_col, row0, col0, n_rows, n_cols, data): cells of a tile in row-major order."""
    keys = [c for c in pixels.columns if c not in ("row", "col", "value")]
    ts = g.tile_size
    each = pixels.withColumns({"tile_row": F.expr(f"CAST(row div {ts} AS INT)"), "tile_col": F.expr(f"CAST(col div {ts} AS INT)")})
    grouped = each.groupBy(*keys, "tile_row", "tile_col").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "col", F.col("value").cast("double").alias("v")))), lambda x: x["v"]).alias("data"))
    size = lambda t, n: F.least(F.lit(ts), F.lit(n) - F.col(t) * ts).cast("int")
    return grouped.select(*keys, "tile_row", "tile_col", (F.col("tile_row") * ts).alias("row0"), (F.col("tile_col") * ts).alias("col0"), size("tile_row", g.n_rows).alias("n_rows"), size("tile_col", g.n_cols).alias("n_cols"), "data")


def to_pixels(tiles: DataFrame) -> DataFrame:
    """(keys, row, col, value) from tiles."""
    keys = [c for c in tiles.columns if c not in ("tile_row", "tile_col", "row0", "col0", "n_rows", "n_cols", "data")]
    each = tiles.select(*keys, "row0", "col0", "n_cols", F.posexplode("data").alias("at", "value"))
    return each.selectExpr(*keys, "CAST(row0 + at div n_cols AS INT) AS row", "CAST(col0 + at % n_cols AS INT) AS col", "value")


def split_area(areas: DataFrame, tile_size: int) -> DataFrame:
    """Inclusive rectangles cut at tile borders: a row for each tile that one meets."""
    rest = [c for c in areas.columns if c not in ("ul_col", "ul_row", "lr_col", "lr_row")]
    t = F.lit(tile_size)
    cut = areas.withColumn("tile_row", F.explode(F.expr(f"sequence(ul_row div {tile_size}, lr_row div {tile_size})"))).withColumn("tile_col", F.explode(F.expr(f"sequence(ul_col div {tile_size}, lr_col div {tile_size})")))
    lo, hi = (lambda a, b: F.greatest(a, F.col(b) * t)), (lambda a, b: F.least(a, F.col(b) * t + t - 1))
    return cut.select(*rest, "tile_row", "tile_col", lo("ul_col", "tile_col").alias("ul_col"), lo("ul_row", "tile_row").alias("ul_row"), hi("lr_col", "tile_col").alias("lr_col"), hi("lr_row", "tile_row").alias("lr_row"))


def tile_offset(g: Grid, tile: Column, base: int = 0) -> Column:
    """First byte of a tile when tiles follow each other from ``base`` on."""
    return F.lit(base).cast("long") + tile.cast("long") * (g.tile_size**2 * int(cell_type(g.pixel_type).code[1]) * g.n_bands)


def cell_offset(g: Grid, row: Column, col: Column, base: int = 0) -> Column:
    """Byte of a cell in a tiled file; ``row`` and ``col`` are longs."""
    ts, size = g.tile_size, int(cell_type(g.pixel_type).code[1]) * g.n_bands
    across = -(-g.n_cols // ts)
    tile = F.floor(row / ts) * across + F.floor(col / ts)
    return tile_offset(g, tile, base) + ((col % ts) + (row % ts) * ts) * size
