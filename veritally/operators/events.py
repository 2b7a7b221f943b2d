"""Burn and backoff over runs' events in completion order, as batch windows; streaming.events has their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def burns(outcomes: DataFrame, run: str = "run", last: int = 8, under: float = 25.0) -> DataFrame:
    """Outcomes of (run, ts, event_id, seconds) at which the ``last`` ones all took under ``under`` seconds."""
    w = Window.partitionBy(run).orderBy("ts", "event_id").rowsBetween(1 - last, 0)
    return outcomes.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("slowest", F.max("seconds").over(w)).where((F.col("n") == last) & (F.col("slowest") < under)).drop("n")


def backoffs(pulls: DataFrame, run: str = "run", streak: int = 3, base: int = 60, most: int = 900) -> DataFrame:
    """Refusals of (run, ts, event_id, refused) with their number since the last success and the sleep that follows."""
    w = Window.partitionBy(run).orderBy("ts", "event_id")
    island = F.sum((~F.col("refused")).cast("int")).over(w)
    own = pulls.withColumn("island", island).where("refused")
    n = F.row_number().over(Window.partitionBy(run, "island").orderBy("ts", "event_id"))
    own = own.withColumn("consecutive", n)
    nap = F.when(F.col("consecutive") < streak, 0).otherwise(F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.col("consecutive") - streak)))
    return own.withColumn("sleep_s", nap.cast("int")).drop("island")
