"""Repair gates and mutation studies over a matrix of test variants and solutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mutation_survival(mutants: DataFrame) -> DataFrame:
    """Mutants and survivors (reward above 0) by bucket, and all together as bucket pooled; a count may be pooled."""
    every = mutants.unionByName(mutants.withColumn("bucket", F.lit("pooled")))
    out = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("mutants"), F.count_if(F.col("reward") > 0).alias("survivors"))
    return out.withColumn("survival", F.col("survivors").cast("double") / F.col("mutants"))


def gate_verdict(cells: DataFrame) -> DataFrame:
    """By task: c1, c2, g1, c3 and their conjunction over (task, variant, solution, is_mutant, reward, present, names_symbol, failing).

    c1: the renamed gold passes the repaired test. c2: every mutant fails it, by detection - no cell names the symbol
    and no mutant has fewer graded ids than gold. g1: gold passes. c3: each mutant fails the same ids in both variants.
    """
    rep, mut = F.col("variant") == "repaired", F.col("is_mutant")
    gold = F.max(F.when(rep & (F.col("solution") == "gold"), F.col("present")))
    least = F.min(F.when(rep & mut, F.col("present")))
    per_mutant = cells.where("is_mutant").groupBy("task", "solution").agg(
        F.max(F.when(F.col("variant") == "original", F.sort_array(F.array_distinct("failing")))).alias("a"),
        F.max(F.when(F.col("variant") == "repaired", F.sort_array(F.array_distinct("failing")))).alias("b"),
    )
    same = per_mutant.groupBy("task").agg(F.min(F.col("a") == F.col("b")).alias("c3"))
    out = cells.groupBy("task").agg(
        F.max(rep & (F.col("solution") == "gold_renamed") & (F.col("reward") == 1)).alias("c1"),
        (
            F.min(F.when(rep & mut, F.col("reward") == 0))
            & ~F.max(F.coalesce(mut & F.col("names_symbol"), F.lit(False)))
            & (least >= gold)
        ).alias("c2"),
        F.max(rep & (F.col("solution") == "gold") & (F.col("reward") == 1)).alias("g1"),
    )
    return out.join(same, "task", "left").withColumn("passes", F.col("c1") & F.col("c2") & F.col("g1") & F.coalesce("c3", F.lit(True)))


#: What has to hold for a recovery of zero to be a finding on the task rather than a defect of the run, in the order of ``zero_checks``.
ZERO_CHECKS = ("round_trip", "no_residue", "ran", "all_reach")


def zero_checks(runs: DataFrame, renamed: DataFrame, residue: DataFrame, reported: DataFrame, reached: DataFrame, key: str) -> DataFrame:
    """runs with the four checks of a zero, zero_checks as their array, and failed_checks, the names of those that fail.

    round_trip: the run renamed files, and undoing gave every one back (renamed: key, restored). no_residue: no file outside the tests
    holds the old name (residue: key). ran: some graded id was reported (reported: key). all_reach: every graded test's failure
    names the symbol (reached: key, reaches, as ``logs.reached`` gives; none graded: holds). Null of a flag is false. Each
    side is one row a run before it is joined.
    """
    own = runs
    for side, value, name in (
        (renamed, F.min(F.coalesce("restored", F.lit(False))), "round_trip"), (residue, F.lit(False), "no_residue"), (reported, F.lit(True), "ran"), (reached, F.min(F.coalesce("reaches", F.lit(False))), "all_reach"),
    ):
        own = own.join(side.groupBy(key).agg(value.alias(name)), key, "left")
    own = own.fillna({"round_trip": False, "no_residue": True, "ran": False, "all_reach": True})
    failed = F.array_compact(F.array(*(F.when(~F.col(c), F.lit(c)) for c in ZERO_CHECKS)))
    return own.withColumn("zero_checks", F.array(*ZERO_CHECKS)).withColumn("failed_checks", failed)


def recovery(rows: DataFrame) -> DataFrame:
    """(recovered, outcome) from n_graded, n_failing and the four checks of a zero: an array of booleans."""
    left = F.col("n_graded") - F.col("n_failing")
    zero = F.when(F.forall("zero_checks", lambda x: F.coalesce(x, F.lit(False))), "helper_coupled").otherwise("recovery_zero_defect")
    return rows.withColumn("recovered", left).withColumn("outcome", F.when(left == 0, zero).otherwise("measured"))


def all_fail_mechanism(rows: DataFrame) -> DataFrame:
    """All-fail witnesses by mechanism: rows, tasks, and graded ids, each task's counted once."""
    own = rows.where("f2p_pass = 0 and p2p_pass = 0").withColumn("mechanism", F.when(F.col("n_reported") == 0, "ran_none").otherwise("ran_some"))
    n = own.groupBy("mechanism").agg(F.count(F.lit(1)).alias("rows"))
    tasks = own.groupBy("mechanism", "task").agg(F.max("n_graded").alias("n_graded")).groupBy("mechanism").agg(F.count(F.lit(1)).alias("tasks"), F.sum("n_graded").alias("n_graded"))
    return n.join(tasks, "mechanism")


def blast_buckets(rows: DataFrame) -> DataFrame:
    """Rows and tasks by bucket: a witness stands if old and new sources agree and did change, is void if they differ."""
    bucket = F.when(F.col("refused") | (F.col("old") != F.col("new")), "void").when((F.col("old") == F.col("new")) & F.col("changed"), "stands").otherwise("undetermined")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("task").alias("tasks"))


def stale_cache(trace: DataFrame) -> DataFrame:
    """Clean rows of a task whose digest is that of its control: the suite was not graded anew."""
    control = trace.where("is_control").groupBy("task").agg(F.min_by("digest", "ordinal").alias("control"))
    return trace.where("not is_control and verdict = 'CLEAN'").join(control, "task").where("digest = control").select("task", "ordinal", "digest")
