"""Grids and jobs: georeferencing, cell types, settings and errors."""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class GridError(Exception):
    """Base of the engine's errors."""


class BadArgument(GridError, ValueError):
    pass


class GridIOError(GridError, OSError):
    pass


class ProjectionError(GridError):
    pass


class EllipsoidNotSupported(ProjectionError):
    pass


class Resampler(Enum):
    NEAREST = "nearest"
    MIN = "min"
    MAX = "max"
    MEAN = "mean"
    BILINEAR = "bilinear"
    BICUBIC = "bicubic"
    LANCZOS = "lanczos"

    @property
    def support(self) -> int:
        return {"bilinear": 1, "bicubic": 2, "lanczos": 3}.get(self.value, 0)


@dataclass(frozen=True)
class CellType:
    """``code``: numpy type of the file form; Spark has no unsigned types, so those are widened."""

    name: str
    code: str
    spark: T.DataType
    least: float
    most: float

    @property
    def wide(self) -> str:
        """The numpy type of the Spark form."""
        return {"u1": "i2", "u2": "i4", "u4": "i8"}.get(self.code, self.code)


# Names, file forms and ranges of cell types.
CELL_TYPES = {
    t.name: t
    for t in (
        CellType("Byte", "u1", T.ShortType(), 0, 255),
        CellType("UInt16", "u2", T.IntegerType(), 0, 65535),
        CellType("Int16", "i2", T.ShortType(), -32768, 32767),
        CellType("UInt32", "u4", T.LongType(), 0, 4294967295),
        CellType("Int32", "i4", T.IntegerType(), -2147483648, 2147483647),
        CellType("Float32", "f4", T.FloatType(), -math.inf, math.inf),
        CellType("Float64", "f8", T.DoubleType(), -math.inf, math.inf),
    )
}


def cell_type(name: str) -> CellType:
    if name not in CELL_TYPES:
        raise BadArgument(f"cell type {name} is not supported")
    return CELL_TYPES[name]


@dataclass(frozen=True)
class Grid:
    """A north-up grid of square cells; (ulx, uly) is the outer corner of cell (0, 0)."""

    srs: str
    ulx: float
    uly: float
    pixel_size: float
    n_rows: int
    n_cols: int
    pixel_type: str = "Float64"
    n_bands: int = 1
    nodata: float | None = None
    tile_size: int = 256
    #: (red, green, blue) of 0 to 65535 for each value of a Byte or UInt16 grid.
    colors: tuple[tuple[int, int, int], ...] | None = None

    def __post_init__(self) -> None:
        cell_type(self.pixel_type)
        if self.pixel_size <= 0 or self.n_rows < 1 or self.n_cols < 1 or self.tile_size < 1:
            raise BadArgument("a grid needs a positive cell size, rows, columns and tile size")
        if self.colors is not None and len(self.colors) != {"Byte": 256, "UInt16": 65536}.get(self.pixel_type):
            raise BadArgument("a colour table has a colour for each value of Byte or UInt16 cells")

    @property
    def geotransform(self) -> tuple[float, ...]:
        return (self.ulx, self.pixel_size, 0.0, self.uly, 0.0, -self.pixel_size)


@dataclass(frozen=True)
class Job:
    """Settings of a reprojection job.  ``fill`` is written outside the source; empty counts as 0."""

    input: str = ""
    output: str = ""
    output_srs: str = "+proj=longlat"
    resampler: Resampler = Resampler.NEAREST
    partition_size: int = 1
    tile_size: int = 1024
    fill: str = ""
    output_ratio: float = 1.0
    timing_file: str = ""
    layout: str = "tile"

    @property
    def fill_value(self) -> float:
        try:
            return float(self.fill)
        except ValueError:
            return 0.0
