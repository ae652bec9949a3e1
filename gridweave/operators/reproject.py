"""Reprojection with resampling, as joins and grouped aggregates over cells.

``pixels`` has (raster_id, row, col, value) and may have ``band``; the keys besides row and col
are carried along, so any number of grids of one shape are done together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import KERNELS
from ..functions.projections import lit
from ..model import BadArgument, CellType, Grid, Resampler, cell_type
from .geometry import cells, pixel_map


def keys_of(pixels: DataFrame) -> list[str]:
    return [c for c in pixels.columns if c not in ("row", "col", "value")]


def source_rectangles(spark, grid_in: Grid, grid_out: Grid, support: int = 0) -> DataFrame:
    """(dst_row, dst_col, ul_col, ul_row, lr_col, lr_row) of output cells that get a value.

    A rectangle that leaves the source below or begins right of it gives none; one that
    ends right of it is cut.
    """
    m = pixel_map(cells(spark, grid_out.n_rows, grid_out.n_cols), grid_out, grid_in, support)
    m = m.where(f"valid AND ul_col <= {grid_in.n_cols - 1} AND lr_row <= {grid_in.n_rows - 1}")
    return m.selectExpr("row AS dst_row", "col AS dst_col", "ul_col", "ul_row", f"least(lr_col, {grid_in.n_cols - 1}) AS lr_col", "lr_row")


def weight_sql(kernel: Callable[[str], str], support: int, grid_in: Grid, grid_out: Grid) -> str:
    """Weight of source cell (row, col) in its rectangle; the kernel is narrowed by the support."""
    ss = lit(support / (grid_out.pixel_size / grid_in.pixel_size))
    one = lambda at, lo, hi: f"({kernel(f'(({at} + 0.5e0 - ({lo} + ({hi} - {lo})/2e0))*{ss})')})*{ss}"
    return f"({one('col', 'ul_col', 'lr_col')})*({one('row', 'ul_row', 'lr_row')})"


def _clean(value: str = "value") -> Column:
    """NaN cells take part in no resampler but nearest."""
    return F.when(~F.isnan(F.col(value).cast("double")), F.col(value))


def reproject(pixels: DataFrame, grid_in: Grid, grid_out: Grid, resampler: Resampler | str = Resampler.NEAREST, fill: float = 0.0, kernel: Callable[[str], str] | None = None) -> DataFrame:
    """(keys, row, col, value) for every cell of ``grid_out`` and every key of ``pixels``.

    Nearest takes the source cell under the output cell's corner; the others reduce the cells
    of a rectangle, which are met by an equi-join on (row, col).  Sums are exact or in double
    and are cast once.  ``kernel``, an expression builder, replaces a weighted resampler's own.
    The small side is the output geometry or the pixels, whichever Spark finds small enough.
    """
    spark, r = pixels.sparkSession, Resampler(resampler)
    if grid_in.pixel_type != grid_out.pixel_type:
        raise BadArgument("source and destination have different cell types")
    keys = keys_of(pixels)
    rect = source_rectangles(spark, grid_in, grid_out, r.support)
    out: Column
    if r is Resampler.NEAREST:
        at = rect.selectExpr("dst_row", "dst_col", "ul_row AS row", "ul_col AS col")
        got = at.join(pixels, ["row", "col"]).select(*keys, "dst_row", "dst_col", "value")
    else:
        rows = rect.select("*", F.explode(F.sequence("ul_row", "lr_row")).alias("row"))
        each = rows.select("*", F.explode(F.sequence("ul_col", "lr_col")).alias("col"))
        joined = each.join(pixels, ["row", "col"])
        if r.support:
            joined = joined.where(~F.isnan(F.col("value").cast("double"))).withColumn("w", F.expr(weight_sql(kernel or KERNELS[r.value], r.support, grid_in, grid_out)))
            out = F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w"))
        else:
            out = {Resampler.MIN: F.min(_clean()), Resampler.MAX: F.max(_clean()), Resampler.MEAN: F.avg(_clean())}[r]
        got = joined.groupBy(*keys, "dst_row", "dst_col").agg(out.alias("value"))
    rasters = pixels.select(*keys).distinct()
    grid = rasters.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(grid_out.n_rows - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(grid_out.n_cols - 1))))
    full = grid.join(got.withColumnsRenamed({"dst_row": "row", "dst_col": "col"}), [*keys, "row", "col"], "left")
    return full.select(*keys, "row", "col", as_cells(F.coalesce("value", F.lit(fill)), cell_type(grid_out.pixel_type)).alias("value"))


def as_cells(value: Column, t: CellType) -> Column:
    """Cast once, truncated and held in the type's range."""
    if t.code[0] == "f":
        return value.cast(t.spark)
    v = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    return F.greatest(F.lit(t.least), F.least(F.lit(t.most), v)).cast(t.spark)


def wrapping_mean(pixels: DataFrame, keys: list[str], t: CellType) -> DataFrame:
    """The mean as integer cells that wrap would give it: the sum modulo the type's range, then
    integer division ("strict" results)."""
    span = int(t.most - t.least) + 1
    total = F.pmod(F.sum(F.col("value").cast("long")) - int(t.least), F.lit(span)) + int(t.least)
    return pixels.groupBy(*keys).agg(total.alias("total"), F.count(F.lit(1)).alias("n")).select(*keys, F.expr("total div n").alias("value"))


def compare(control: DataFrame, test: DataFrame, delta: float = 0.001) -> DataFrame:
    """One row (n_cells, n_missing, n_bad): cells in either, in one only, and that differ by more
    than ``delta``.  NaN differs from nothing."""
    on = [c for c in control.columns if c != "value"]
    both = control.withColumnRenamed("value", "a").withColumn("in_a", F.lit(True)).join(test.withColumnRenamed("value", "b").withColumn("in_b", F.lit(True)), on, "full_outer")
    gap = F.abs(F.col("a").cast("double") - F.col("b").cast("double"))
    return both.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("n_missing"), F.count_if((gap > delta) & ~F.isnan(gap)).alias("n_bad"))


TIMES = ["total", "preloop", "minbox", "read", "resample", "write", "misc"]


def timing_summary(timing: DataFrame) -> DataFrame:
    """Means of the metrics over processes."""
    return timing.agg(*[F.avg(c).alias(c) for c in TIMES])


def write_timing(timing: DataFrame, path: str) -> None:
    """Two CSV folders: the averages, and a row for each process."""
    timing_summary(timing).coalesce(1).write.mode("overwrite").csv(f"{path}/average", header=True)
    timing.select("process", *TIMES).orderBy("process").write.mode("overwrite").csv(f"{path}/processes", header=True)
