"""Tiles kept as Parquet, along a curve that keeps neighbours together, so that a window reads few row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BadArgument
from ..operators.tilewise import spread

#: Bytes of a row group: some tiles, so that the least and greatest row and column of a group are close together.
GROUP_BYTES = 4 << 20


def curve(row: int, col: int) -> int:
    """``spread`` of one tile."""
    return sum((row >> k & 1) << 2 * k + 1 | (col >> k & 1) << 2 * k for k in range(24))


def write_store(tiles: DataFrame, path: str, group_bytes: int = GROUP_BYTES, partitions: int | None = None) -> None:
    """Write tiles with their place on the curve, ``place``; they are dealt by ranges of it and sorted by it.

    A tile row or column beyond 2^24 - 1, or a column named ``place``, raises.
    """
    if "place" in tiles.columns:
        raise BadArgument("tiles must not have a column place")
    keys = [c for c in tiles.columns if c not in ("tile_row", "tile_col", "row0", "col0", "n_rows", "n_cols", "data")]
    fits = F.when(F.greatest("tile_row", "tile_col") < 1 << 24, F.expr(spread("tile_row", "tile_col"))).otherwise(F.raise_error(F.lit("a tile is beyond the curve")).cast("long"))
    placed = tiles.withColumn("place", fits)
    dealt = placed.repartitionByRange(partitions, "place", *keys) if partitions else placed.repartitionByRange("place", *keys)
    dealt.sortWithinPartitions("place", *keys).write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)


def read_window(spark: SparkSession, path: str, tile_size: int, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """The tiles that meet a window of cells, inclusive; the scan skips row groups by rows, columns and place."""
    r0, r1, c0, c1 = top // tile_size, bottom // tile_size, left // tile_size, right // tile_size
    near = F.col("tile_row").between(r0, r1) & F.col("tile_col").between(c0, c1) & F.col("place").between(curve(r0, c0), curve(r1, c1))
    return spark.read.parquet(path).where(near).drop("place")


def window_cells(tiles: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """(keys, row, col, value) of a window, from ``read_window``."""
    from ..operators.tiles import to_pixels

    return to_pixels(tiles).where(F.col("row").between(top, bottom) & F.col("col").between(left, right))
