"""Rates, availability, counts and partitions over records and verdict rows.

records: instance_id, control_passed, multi_target, n_targets. rows: instance_id, operator, verdict, loud_failure,
observable, witness_side. Only tasks whose control passed are a denominator. A rate is always of one operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritally.functions.expressions import rounded, wilson
from veritally.schemas import JUDGED, WITNESS_SIDES


def controlled(records: DataFrame) -> DataFrame:
    """Records whose control passed."""
    return records.where("control_passed")


def _per_task(rows: DataFrame, own: DataFrame, *by: str) -> DataFrame:
    """Rows of own's tasks, a task's folded to one for each operator, so that a task counts once however many rows it has.

    Rows are dealt out by task before they are folded: a task's few rows lie together, so nothing is gained by folding them where they are read, and what
    that keeps in memory grows with a scan's split, which holds more rows than a partition of a shuffle.
    """
    return rows.select("instance_id", "operator", "verdict").repartition("instance_id").join(own, "instance_id").groupBy("instance_id", "operator", *by).agg(
        F.max(F.col("verdict").isin(*JUDGED)).alias("judged"),
        F.max(F.col("verdict") == "WITNESS").alias("witness"),
        F.max(F.col("verdict") != "NOT_APPLICABLE").alias("anchored"),
    )


def _rates(tasks: DataFrame, *by: str) -> DataFrame:
    out = tasks.groupBy(*by, "operator").agg(F.count_if("judged").alias("judged_tasks"), F.count_if(F.col("judged") & F.col("witness")).alias("witness_tasks"))
    low, high = wilson(F.col("witness_tasks"), F.col("judged_tasks"))
    rate = F.try_divide(F.col("witness_tasks").cast("double"), F.col("judged_tasks"))
    return out.withColumn("rate", rounded(rate)).withColumn("wilson_low", low).withColumn("wilson_high", high)


def witness_rate(records: DataFrame, rows: DataFrame) -> DataFrame:
    """By operator: judged and witness tasks among controlled ones, the rate and its interval (null without any)."""
    return _rates(_per_task(rows, controlled(records).select("instance_id")))


def witness_rate_of(records: DataFrame, rows: DataFrame, operator: str) -> DataFrame:
    """The rate of one named operator; there is none across operators."""
    if not operator or not isinstance(operator, str):
        raise ValueError("a witness rate is of a single operator; name one")
    return witness_rate(records, rows.where(F.col("operator") == operator))


def witness_rate_by_stratum(records: DataFrame, rows: DataFrame) -> DataFrame:
    """witness_rate for tasks with a single and with several targets; tasks counts all records of the stratum."""
    stratum = F.when(F.col("multi_target"), "multi").otherwise("single").alias("stratum")
    sizes = records.groupBy(stratum).agg(F.count(F.lit(1)).alias("tasks"))
    return _rates(_per_task(rows, controlled(records).select("instance_id", stratum), "stratum"), "stratum").join(F.broadcast(sizes), "stratum")  # two rows


def sensitivity(records: DataFrame, rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """(operator, subset, grouping, value, judged_tasks, witness_tasks, rate, wilson_low, wilson_high, median): how far a rate hangs on a part of its tasks.

    groups: Columns of records by name. For each operator there are all its tasks (subset all), those of each group (only) and those of all other groups
    (without), which are the totals minus the group's; so one scan and one aggregation by grouping sets serve all subsets. median is that of the
    groups' own rates, of those with any judged task, beside each row of a grouping. Nothing is put together across operators.
    """
    named = [F.col(c) for c in groups]
    own = controlled(records).select("instance_id", *(F.coalesce(c.cast("string"), F.lit("null")).alias(n) for n, c in groups.items()))
    tasks = _per_task(rows, own, *groups)
    sets = [[F.col("operator")]] + [[F.col("operator"), c] for c in named]
    judged, witness = F.count_if("judged").alias("judged"), F.count_if(F.col("judged") & F.col("witness")).alias("witness")
    counts = tasks.groupingSets(sets, "operator", *named).agg(judged, witness, F.grouping_id().alias("gid"))
    whole = (1 << len(groups)) - 1  # operator leads, so a group's bit is 0 where it is kept
    kept = [(n, whole & ~(1 << (len(groups) - 1 - i))) for i, n in enumerate(groups)]
    grouping, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, gid in kept:
        grouping, value = F.when(F.col("gid") == gid, n).otherwise(grouping), F.when(F.col("gid") == gid, F.col(n)).otherwise(value)
    counts = counts.select("operator", grouping.alias("grouping"), value.alias("value"), "judged", "witness")
    all_tasks = Window.partitionBy("operator")
    total = lambda c: F.max(F.when(F.col("grouping").isNull(), F.col(c))).over(all_tasks)
    share = F.try_divide(F.col("witness").cast("double"), F.col("judged"))
    median = F.when(F.col("grouping").isNotNull(), F.percentile(share, F.lit(0.5)).over(Window.partitionBy("operator", "grouping")))
    counts = counts.withColumns({"all_judged": total("judged"), "all_witness": total("witness"), "median": median})
    part = lambda name, j, w: F.struct(F.lit(name).alias("subset"), j.alias("judged_tasks"), w.alias("witness_tasks"))
    one = F.array(part("only", F.col("judged"), F.col("witness")), part("without", F.col("all_judged") - F.col("judged"), F.col("all_witness") - F.col("witness")))
    first = F.array(part("all", F.col("judged"), F.col("witness")))
    out = counts.select("operator", "grouping", "value", "median", F.explode(F.when(F.col("grouping").isNull(), first).otherwise(one)).alias("x")).select("operator", "x.*", "grouping", "value", "median")
    low, high = wilson(F.col("witness_tasks"), F.col("judged_tasks"))
    rate = rounded(F.try_divide(F.col("witness_tasks").cast("double"), F.col("judged_tasks")))
    return out.select("operator", "subset", "grouping", "value", "judged_tasks", "witness_tasks", rate.alias("rate"), low.alias("wilson_low"), high.alias("wilson_high"), "median")


def anchor_availability(records: DataFrame, rows: DataFrame) -> DataFrame:
    """By operator over controlled tasks: tasks with a row, those with an anchor, and the share."""
    tasks = _per_task(rows, controlled(records).select("instance_id"))
    out = tasks.groupBy("operator").agg(F.count(F.lit(1)).alias("tasks"), F.count_if("anchored").alias("with_anchor"))
    return out.withColumn("availability", rounded(F.col("with_anchor").cast("double") / F.col("tasks")))


def verdict_counts(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows by operator and verdict over controlled tasks: counts, not rates."""
    return rows.join(controlled(records).select("instance_id"), "instance_id").groupBy("operator", "verdict").agg(F.count(F.lit(1)).alias("n"))


def loud_silent(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Judged rows, witnesses and operators by the rows' own flag, over controlled tasks."""
    own = rows.join(controlled(records).select("instance_id"), "instance_id")
    return own.groupBy(F.when(F.col("loud_failure"), "loud").otherwise("silent").alias("part")).agg(
        F.count_if(F.col("verdict").isin(*JUDGED)).alias("judged"),
        F.count_if(F.col("verdict") == "WITNESS").alias("witnesses"),
        F.array_join(F.sort_array(F.collect_set("operator")), ",").alias("operators"),
    )


def witness_split(rows: DataFrame) -> DataFrame:
    """Witness rows of all records by side; a side nobody has counts zero, a null side is unknown."""
    sides = rows.sparkSession.createDataFrame([(s,) for s in WITNESS_SIDES], "side string")
    own = rows.where("verdict = 'WITNESS'").groupBy(F.coalesce("witness_side", F.lit("unknown")).alias("side")).agg(F.count(F.lit(1)).alias("n"))
    return sides.join(own, "side", "left").select("side", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def coupling_types(rows: DataFrame) -> DataFrame:
    """Witness rows of all records by operator and observable."""
    return rows.where("verdict = 'WITNESS'").groupBy(F.concat_ws("::", "operator", "observable").alias("coupling")).agg(F.count(F.lit(1)).alias("n"))


def unparsed_logs(rows: DataFrame) -> DataFrame:
    """Rows and tasks with failures of an unknown log shape; verdicts without grading of their own do not count."""
    own = rows.where("size(failure_analysis.unparsed) > 0 and verdict not in ('NOT_APPLICABLE', 'REFUSED')")
    return own.groupBy("operator").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("instance_id").alias("tasks"))


def record_counts(records: DataFrame) -> DataFrame:
    """One row: records, controlled and failed controls, controlled tasks with several targets."""
    return records.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if("control_passed").alias("n_controlled"),
        F.count_if(~F.col("control_passed")).alias("n_control_failed"),
        F.count_if(F.col("control_passed") & F.col("multi_target")).alias("n_multi_target"),
    )


def target_histogram(records: DataFrame) -> DataFrame:
    """Records by number of targets."""
    return records.groupBy("n_targets").agg(F.count(F.lit(1)).alias("n"))


def eligibility_summary(tasks: DataFrame) -> DataFrame:
    """One row: tasks, eligible ones, those of a single file, and their shares of the eligible."""
    out = tasks.agg(F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("n_eligible"), F.count_if(F.col("eligible") & F.col("single_file")).alias("n_single_file"))
    return out.withColumn("share_single_file", rounded(F.try_divide(F.col("n_single_file").cast("double"), F.col("n_eligible"))))


def suite_loss(tasks: DataFrame, failing: str = "failing", graded: str = "graded") -> DataFrame:
    """Tasks by the share of graded tests that fail."""
    share = F.try_divide(100.0 * F.col(failing), F.col(graded))
    bucket = F.when(share >= 100, "100%").when(share >= 50, "50-99%").when(share >= 20, "20-49%").when(share >= 5, "5-19%").otherwise("<5%")
    return tasks.where(F.col(graded) > 0).groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("tasks"), F.sum(failing).alias("failing"), F.sum(graded).alias("graded"))


def refusal_classes(rows: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """Refused rows and their tasks by the first class whose condition holds."""
    kind = F.lit("other")
    for name, holds in reversed(classes.items()):
        kind = F.when(holds, name).otherwise(kind)
    return rows.where("verdict = 'REFUSED'").groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("instance_id").alias("tasks"))


def share_true(df: DataFrame, flag: str, *by: str) -> DataFrame:
    """How many rows of a group hold a flag, and their share; null is not true."""
    on = F.count_if(F.coalesce(F.col(flag), F.lit(False)))
    return df.groupBy(*by).agg(on.alias("n_true"), F.count(F.lit(1)).alias("n"), (on.cast("double") / F.count(F.lit(1))).alias("share"))


def top_values(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k commonest values, ties by value."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(k)
