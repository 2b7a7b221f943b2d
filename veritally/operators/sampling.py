"""Quotas, stratified draws and round robins, by hashes of ids rather than by a driver's random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def allocate(counts: DataFrame, total: int, within: list[str], key: str, count: str = "n") -> DataFrame:
    """counts plus quota: largest-remainder shares of ``total`` (a number, or a column's name) in each of ``within``.

    Ties go to the smaller key. counts holds one row per key, not per task, so its windows are short.
    """
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    want = F.col(total) if isinstance(total, str) else F.lit(total)
    exact = F.col(count) * want / F.sum(count).over(w)
    out = counts.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact").cast("long"))
    short = want - F.sum("_floor").over(w)
    rank = F.row_number().over(w.orderBy(F.desc(F.col("_exact") - F.col("_floor")), key))
    return out.withColumn("quota", F.col("_floor") + (rank <= short).cast("long")).drop("_exact", "_floor")


def draw_order(seed: int, key: str) -> Column:
    """A fixed random order of ids: their hash with the seed."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)


def _lowest(tasks: DataFrame, by: list[str], seed: int, key: str, quota: DataFrame) -> DataFrame:
    """The ``quota`` rows of each group with the lowest hashes. A rank filter on the window lets Spark shorten groups early."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_h", key))
    own = tasks.join(quota, by).withColumn("_h", draw_order(seed, key))
    return own.withColumn("_r", rank).where("_r <= quota").drop("_h", "_r", "quota")


def stratified(tasks: DataFrame, n: int, seed: int, stratum: str, group: str, key: str = "instance_id") -> DataFrame:
    """A draw of n tasks: quotas by stratum, then by group in the stratum, then the lowest hashes."""
    counts = tasks.groupBy(stratum, group).agg(F.count(F.lit(1)).alias("n"))
    outer = allocate(counts.groupBy(stratum).agg(F.sum("n").alias("n")), n, [], stratum).select(stratum, F.col("quota").alias("want"))
    inner = allocate(counts.join(outer, stratum), "want", [stratum], group).select(stratum, group, "quota")
    return _lowest(tasks, [stratum, group], seed, key, inner)


def seeded_limit(tasks: DataFrame, n: int, seed: int, key: str = "instance_id") -> DataFrame:
    """n tasks by the lowest hashes: a top-k, in the order of ids."""
    return tasks.withColumn("_h", draw_order(seed, key)).orderBy("_h", key).limit(n).drop("_h").orderBy(key)


def round_robin(tasks: DataFrame, k: int, group: str, order: str) -> DataFrame:
    """k tasks: the first of each group in the groups' order of first appearance, then the second of each, and so on.

    The first appearances are an aggregate of their own, so that the rank filter alone is left to the window and Spark can cut
    each group to k rows before they are shuffled.
    """
    first = tasks.groupBy(group).agg(F.min(order).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    short = tasks.withColumn("_rank", rank).where(F.col("_rank") <= k)
    return short.join(first, group).orderBy("_rank", "_first").limit(k).select(*tasks.columns)
