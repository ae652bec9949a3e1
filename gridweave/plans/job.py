"""The whole job: read a grid, size the output, reproject, write; and its command line."""

from __future__ import annotations

import argparse
import json
import os
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..model import BadArgument, Grid, Job, Resampler
from ..operators.geometry import output_grid
from ..operators.reproject import TIMES, write_timing
from ..operators.tilewise import Seconds, reproject_file
from ..sources.bigtiff import read_header, register, write_grid


def plan(spark: SparkSession, job: Job, spent: Seconds | None = None) -> tuple[DataFrame, Grid]:
    """The output's tiles, lazily, and its grid.  Only source tiles that the output needs are read."""
    source = read_header(job.input).grid
    grid = output_grid(spark, source, job.output_srs, job.tile_size, job.output_ratio, float(job.fill) if job.fill else None)
    return reproject_file(spark, job.input, source, grid, job.resampler, job.fill_value, partition_size=job.partition_size, spent=spent), grid


def run(spark: SparkSession, job: Job) -> Grid:
    """One plan and one write; ``partition_size`` output tiles are mapped by one task.

    The timing file has, for each process that worked, the seconds it spent on boxes, reading and resampling, and for each
    writing task those of writing: all measured in the tasks.  ``total`` is the whole job's, ``preloop`` that of planning,
    ``misc`` what is left of the total: the engine's own work, shuffles and waiting.
    """
    if not job.input or not job.output:
        raise BadArgument("input and output are needed")
    if job.partition_size < 1:
        raise BadArgument("the partition size must be positive")
    began = time.time()
    register(spark)
    spent = Seconds(spark)
    read_header(job.input)
    opened = time.time()
    tiles, grid = plan(spark, job, spent)
    # sizing is planning; the boxes, which plan() works out as well, are counted by the tasks
    ready = time.time()
    told = f"{job.output}.times-{uuid.uuid4().hex}" if job.timing_file else ""
    write_grid(tiles, grid, job.output, job.layout, **({"timings": told} if told else {}))
    if job.timing_file:
        total = time.time() - began
        with open(told) as f:
            wrote = json.load(f)
        os.remove(told)
        write_timing(spark.createDataFrame(_times(spent.value, wrote, total, opened - began, ready - opened), ", ".join(["process int", *(f"{c} double" for c in TIMES)])), job.timing_file)
    return grid


def _times(spent: dict[str, dict[str, float]], wrote: dict, total: float, opening: float, planning: float) -> list[tuple]:
    """A row for each process: seconds by step, of which ``misc`` is what is left of the total."""
    rows, writers = [], wrote["tasks"] or [0.0]
    steps = list(spent.values()) or [{}]
    # tasks that write are not tied to processes; each process has their mean
    share = (sum(writers) + wrote["commit"]) / len(steps)
    for k, own in enumerate(steps):
        boxes, read, kernel = (own.get(c, 0.0) for c in ("minbox", "read", "resample"))
        preloop = opening + max(0.0, planning - max(x.get("minbox", 0.0) for x in steps))
        rows.append((k, total, preloop, boxes, read, kernel, share, max(0.0, total - preloop - boxes - read - kernel - share)))
    return rows


def parse_args(args: Sequence[str]) -> Job:
    p = argparse.ArgumentParser(prog="gridweave")
    p.add_argument("--t_srs", "-p", default="+proj=longlat", help="output reference system")
    p.add_argument("--s_srs", default="", help="kept for compatibility; the file's own system is used")
    p.add_argument("--partition-size", "-n", type=int, default=1, help="tiles in a block")
    p.add_argument("--resampler", "-r", default="bilinear", choices=[r.value for r in Resampler])
    p.add_argument("--dstnodata", "-f", default="", help="fill and nodata value")
    p.add_argument("--tile-size", "-x", type=int, default=1024)
    p.add_argument("--timing-file", "-c", default="")
    p.add_argument("--output-ratio", type=float, default=1.0)
    p.add_argument("--layout", default="tile", choices=["tile", "strip"], help="blocks of the output file")
    p.add_argument("input")
    p.add_argument("output")
    a = p.parse_args(args)
    return Job(a.input, a.output, a.t_srs, Resampler(a.resampler), a.partition_size, a.tile_size, a.dstnodata, a.output_ratio, a.timing_file, a.layout)


def main(args: Sequence[str] | None = None) -> None:
    import sys

    run(SparkSession.builder.appName("gridweave").getOrCreate(), parse_args(sys.argv[1:] if args is None else args))


if __name__ == "__main__":
    main()
