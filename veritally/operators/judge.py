"""Variance of a judge over repeated calls: instrument check, spreads, arms, and the gate, in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def instrument(calls: DataFrame, least_rate: float = 0.95) -> DataFrame:
    """One row: calls, usable scores, parse rate, calls at the output cap, and whether the run is void or stops."""
    out = calls.agg(F.count(F.lit(1)).alias("calls"), F.count("score").alias("usable"), F.count_if(F.coalesce("output_cap_hit", F.lit(False))).alias("cap_hits"))
    out = out.withColumn("parse_rate", F.when(F.col("calls") > 0, F.col("usable").cast("double") / F.col("calls")).otherwise(0.0))
    return out.withColumn("void", F.col("cap_hits") > 0).withColumn("stop", ~F.col("void") & (F.col("parse_rate") < least_rate))


def spread(calls: DataFrame, needed: int, by: tuple[str, ...] = ("arm", "task")) -> DataFrame:
    """By arm and task: n, least, most, observed_range, mean, stdev, and range, which is null under ``needed`` scores.

    stdev is of the sample and 0 for a single score. A range of too few scores is no range of 0.
    """
    s = F.col("score")
    out = calls.groupBy(*by).agg(
        F.count("score").alias("n"), F.count_if(s.isNull()).alias("parse_failures"), F.min("score").alias("least"), F.max("score").alias("most"),
        F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"),
    )
    out = out.withColumn("stdev", F.when(F.col("n") == 1, 0.0).otherwise(F.col("sd"))).drop("sd")
    out = out.withColumn("observed_range", F.col("most") - F.col("least"))
    return out.withColumn("range", F.when(F.col("n") >= needed, F.col("observed_range")))


def arm_aggregate(spreads: DataFrame, least_tasks: int) -> DataFrame:
    """By arm: counting tasks, the median and largest admitted range (null under ``least_tasks``), tasks with range 0."""
    out = spreads.groupBy("arm").agg(
        F.count("range").alias("counting_tasks"), F.percentile("range", F.lit(0.5)).alias("median_all"), F.max("range").alias("max_all"),
        F.count_if(F.col("range") == 0).alias("tasks_with_range_0"), F.sum("parse_failures").alias("parse_failures"),
    )
    covered = F.col("counting_tasks") >= least_tasks
    return out.select(
        "arm", "counting_tasks", covered.alias("covered"), F.when(covered, F.col("median_all")).alias("median_range"), F.when(covered, F.col("max_all")).alias("max_range"),
        "tasks_with_range_0", "parse_failures",
    )


def gate(check: DataFrame, arms: DataFrame) -> DataFrame:
    """By arm: whether the gate was evaluated and whether it opens; void, then stop, then coverage, then the bounds."""
    both = arms.crossJoin(check.select("void", "stop"))  # one row
    evaluated = ~F.col("void") & ~F.col("stop")
    opens = F.when(evaluated & F.col("covered"), (F.col("median_range") <= 2) & (F.col("max_range") <= 4)).when(evaluated, False)
    reason = F.when(F.col("void"), "void").when(F.col("stop"), "stop").when(~F.col("covered"), "coverage").otherwise("bounds")
    return both.select("arm", evaluated.alias("evaluated"), opens.alias("opens"), reason.alias("reason"))


def payload_constancy(calls: DataFrame, digest: str = "digest") -> DataFrame:
    """Arms and tasks whose calls did not all send the same payload."""
    return calls.groupBy("arm", "task").agg(F.countDistinct(digest).alias("payloads")).where("payloads > 1")
