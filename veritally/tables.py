"""Cutting lineage between rounds, by files that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the session's ``spark.checkpoint.dir``; where none is set, in a temporary folder on one machine, and an error on a cluster."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='veritally-')}")
    return df.checkpoint()
