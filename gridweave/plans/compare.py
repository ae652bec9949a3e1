"""Comparison of two grid files, with a verdict: ``python -m gridweave.plans.compare control.tif test.tif``."""

from __future__ import annotations

import argparse
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..model import GridError
from ..sources.bigtiff import TileFile, read_header

#: Cells that differ by no more are the same.
DELTA = 0.001
#: Differences that are printed.
SHOWN = 20
WINDOW = 256


def differences(spark: SparkSession, control: str, test: str, delta: float = DELTA) -> DataFrame:
    """(band, row, col, a, b) of cells that differ by more than ``delta``; NaN differs from nothing.

    Both files must have the same rows, columns and bands.  Each task reads the same windows of both, whatever
    their layouts, so nothing is shuffled.
    """
    g = read_header(control).grid
    across = -(-g.n_cols // WINDOW)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with TileFile(control) as one, TileFile(test) as two:
            for i in (i for batch in batches for i in batch.column(0).to_pylist()):
                r, c = i // across * WINDOW, i % across * WINDOW
                size = min(WINDOW, g.n_rows - r), min(WINDOW, g.n_cols - c)
                a, b = (f.window(r, c, *size).astype(float) for f in (one, two))
                with np.errstate(invalid="ignore"):
                    row, col, band = np.nonzero(np.abs(a - b) > delta)
                ints = [pa.array(x.astype(np.int32)) for x in (band + 1, row + r, col + c)]
                yield pa.RecordBatch.from_arrays([*ints, pa.array(a[row, col, band]), pa.array(b[row, col, band])], ["band", "row", "col", "a", "b"])

    n = -(-g.n_rows // WINDOW) * across
    return spark.range(0, n, 1, max(1, -(-n // 16))).mapInArrow(look, "band int, row int, col int, a double, b double")


def compare_files(spark: SparkSession, control: str, test: str, delta: float = DELTA) -> int:
    """0 if the files agree; 1 if one cannot be opened, sizes or bands differ, or any cell does.  What differs is printed."""
    found = []
    for name, path in (("control", control), ("test", test)):
        try:
            found.append(read_header(path).grid)
        except GridError as e:
            print(f"The {name} grid cannot be opened: {e}")
            return 1
    for what, a, b in (("rows", found[0].n_rows, found[1].n_rows), ("columns", found[0].n_cols, found[1].n_cols), ("bands", found[0].n_bands, found[1].n_bands)):
        if a != b:
            print(f"The control grid has {a} {what}, the test grid {b}")
            return 1
    bad = differences(spark, control, test, delta)
    n = bad.count()
    for r in bad.orderBy("band", "row", "col").limit(SHOWN).collect() if n else []:
        print(f"band {r.band}, row {r.row}, column {r.col}: {r.a} and {r.b}")
    if n:
        print(f"{n} cells differ")
    return int(n > 0)


def main(args: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gridweave-compare")
    p.add_argument("--delta", type=float, default=DELTA)
    p.add_argument("control")
    p.add_argument("test")
    a = p.parse_args(args)
    return compare_files(SparkSession.builder.appName("gridweave-compare").getOrCreate(), a.control, a.test, a.delta)


if __name__ == "__main__":
    raise SystemExit(main())
