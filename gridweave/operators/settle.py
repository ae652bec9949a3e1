"""Cutting the lineage of a table that is read more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Where it is unset and all runs on this machine (tests), a folder of our own is taken.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="gridweave-"))
    return df.checkpoint(eager=True)
