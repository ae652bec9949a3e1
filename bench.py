"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time
from dataclasses import replace
from statistics import median

from pyspark.sql import DataFrame, SparkSession

from gridweave import registry
from gridweave.model import Grid
from gridweave.operators import tilewise

NAMES = (
    "reproject_nearest_sinu", "reproject_mean_sinu", "reproject_bilinear", "reproject_lanczos", "projected_minbox_corrected", "raster_minbox_per_block", "tile_roundtrip", "raster_compare_badpixels",
    "reproject_file_mean_sinu", "geotiff_roundtrip", "tile_store_window",
)
#: Cells of the large grid that is made in tasks and reprojected tile by tile.
LARGE = 10_000


def large(spark: SparkSession) -> tuple[DataFrame, Grid]:
    """Tiles of 500 x 500 of a grid of LARGE x LARGE cells (10^8) over the western half of the globe."""
    rows, cols, ts = LARGE, LARGE, 500
    source = Grid("+proj=longlat", -180.0, 90.0, 180.0 / rows, rows, cols, "Byte", tile_size=ts)
    ids = spark.range(0, (rows // ts) * (cols // ts), 1, 64).selectExpr(f"CAST(id div {cols // ts} AS INT) AS tile_row", f"CAST(id % {cols // ts} AS INT) AS tile_col")
    tiles = ids.selectExpr("tile_row", "tile_col", f"tile_row*{ts} AS row0", f"tile_col*{ts} AS col0", f"{ts} AS n_rows", f"{ts} AS n_cols", f"transform(sequence(1, {ts * ts}), i -> CAST((i + tile_row*7 + tile_col) % 251 AS DOUBLE)) AS data")
    return tiles, source


def same_size(spark: SparkSession) -> DataFrame:
    """All cells nearest to sinusoidal, as many cells out as in."""
    tiles, source = large(spark)
    out = replace(source, srs="+proj=sinu", ulx=-20015077.0, uly=10007538.0, pixel_size=2 * 10007538.0 / LARGE)
    return tilewise.reproject_tiles(tiles, source, out, partition_size=4)


def one_tile(spark: SparkSession) -> DataFrame:
    """All cells averaged into one tile of 40 x 64: a fan-in of all source tiles."""
    tiles, source = large(spark)
    return tilewise.reproject_tiles(tiles, source, Grid("+proj=cea", -20015077.0, 6370997.0, 20015077.0 / 64, 40, 64, "Byte", tile_size=64), "mean")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in NAMES:
        runs = []
        for _ in range(4):  # the first one warms up
            began = time.time()
            registry.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(median(runs[1:]), 3)
    for name, made in (("reproject_tiles_1e8_cells", same_size), ("downsample_1e8_cells_to_one_tile", one_tile)):
        began = time.time()
        made(spark).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf), "cells_per_sec": round(LARGE**2 / times["reproject_tiles_1e8_cells"])}))


if __name__ == "__main__":
    main()
