"""Verdicts by oracles and scopes: what may be judged, what an oracle says, and totals that show what a zero is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_scope(anchors: DataFrame, scope: DataFrame, key: str = "instance_id", unscoped: DataFrame | None = None) -> DataFrame:
    """Anchors whose function, or else name, is a symbol of their task's scope.

    anchors: key, func, name. scope: key, symbol. A task without any symbol in scope admits no anchor, unless it is among
    ``unscoped`` (key): those have no scope to keep to, and admit all.
    """
    named = anchors.withColumn("symbol", F.coalesce("func", "name"))
    inside = named.join(scope.select(key, "symbol").distinct(), [key, "symbol"], "left_semi")
    if unscoped is not None:
        free = unscoped.select(key).distinct()
        inside = inside.join(free, key, "left_anti").unionByName(named.join(free, key, "left_semi"))
    return inside.select(*anchors.columns)


def operators_by_anchor(rows: DataFrame, key: str = "instance_id") -> DataFrame:
    """(key, operators_with_anchors, operators_not_applicable): an operator has an anchor if any of its rows is applicable."""
    per = rows.groupBy(key, "operator").agg(F.max(F.col("verdict") != "NOT_APPLICABLE").alias("anchored"))
    lists = (F.sort_array(F.collect_set(F.when(on, F.col("operator")))).alias(name) for name, on in (("operators_with_anchors", F.col("anchored")), ("operators_not_applicable", ~F.col("anchored"))))
    return per.groupBy(key).agg(*lists)


def mountable(row: str = "row") -> Column:
    """Whether a record's task was set up: it has a row, and the row no error."""
    return F.col(row).isNotNull() & F.col(f"{row}.error_type").isNull()


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, whatever their order and repetition; null where either is."""
    return F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b))


def markers_hold(printed: Column, expected: Column) -> Column:
    """Whether a comma-separated print-out names exactly the expected markers; nothing printed is the empty set."""
    got = F.filter(F.split(F.trim(F.coalesce(printed, F.lit(""))), ","), lambda m: m != "")
    return same_set(got, expected)


def suite_holds(loud: Column, broke: Column, unparsed: Column) -> Column:
    """What a task's own suite says of a rewrite: true, false, or null where it cannot judge.

    It cannot judge an operator that fails silently, nor a log with failures of no known shape. Tests that fail by naming the
    symbol are no broken behaviour.
    """
    return F.when(F.coalesce(loud, F.lit(False)) & (F.size(unparsed) == 0), F.size(broke) == 0)


def phase_two(contract: Column, expected_failing: Column) -> Column:
    """The verdict on a case: outcome, markers, observed, reward, p2p_fail, f2p_failing; what did not run keeps its outcome."""
    return (
        F.when(F.col("outcome") != "RAN", F.col("outcome"))
        .when(~same_set(F.col("markers"), contract), "INVALID")
        .when(~F.coalesce(F.col("observed"), F.lit(False)), "UNVALIDATED")
        .when(F.col("reward") == 1, "CLEAN")
        .when(F.col("p2p_fail") > 0, "BROKEN_OTHER")
        .when(F.sort_array("f2p_failing") != F.sort_array(expected_failing), "BROKEN_OTHER")
        .otherwise("WITNESS")
    )


def gate_grid(variants: DataFrame, solutions: DataFrame, cells: DataFrame, keys: tuple[str, ...] = ("task",)) -> DataFrame:
    """Every variant by solution of a task, with its cell; one that was not run stays with nulls.

    variants: keys, variant. solutions: keys, solution. Both are the short lists of one task.
    """
    return variants.join(solutions, list(keys)).join(cells, [*keys, "variant", "solution"], "left")


def task_spec(corpus: DataFrame) -> DataFrame:
    """What a run needs of a classified corpus row: id, repo, version, base commit, targets, and the graded ids."""
    return corpus.select(
        "instance_id", "repo", "version", "base_commit", "targets", F.size("targets").alias("n_targets"), (F.size("targets") > 1).alias("multi_target"),
        F.col("FAIL_TO_PASS").alias("f2p"), F.col("PASS_TO_PASS").alias("p2p"),
    )


def graded_once(rows: DataFrame, grade, digest: str = "digest") -> DataFrame:
    """rows with the grading of their content, each different content graded once.

    grade: a function from the distinct contents to a DataFrame with the digest and what it found.
    """
    return rows.join(grade(rows.dropDuplicates([digest])), digest, "left")


def overlay_problems(touched: DataFrame, test_files: DataFrame, key: str = "overlay") -> DataFrame:
    """(key, problem, path): paths of an overlay that leave its test files, or that are production files.

    touched: key, path, production. test_files: key, path. ``empty`` is for an overlay of test_files without any touched path.
    Files are often listed by an explode, whose rows Spark's estimate does not foresee, so they are not left to be broadcast.
    """
    outside = touched.join(test_files.hint("merge"), [key, "path"], "left_anti").select(key, F.lit("outside").alias("problem"), "path")
    bad = touched.where("production").select(key, F.lit("production").alias("problem"), "path")
    empty = test_files.select(key).distinct().join(touched.select(key).distinct().hint("merge"), key, "left_anti").select(key, F.lit("empty").alias("problem"), F.lit(None).cast("string").alias("path"))
    return outside.unionByName(bad).unionByName(empty)
