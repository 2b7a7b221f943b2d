"""Joins and set operations: verdict diffs, drift, presence, guards by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions.expressions import same_words
from veritally.schemas import JUDGED


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by an ordinal, as a later entry replaces an earlier one."""
    others = [c for c in rows.columns if c not in (*keys, order)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("x"))
    return last.select(*keys, "x.*")


def verdict_diff(reference: DataFrame, run: DataFrame) -> DataFrame:
    """(operator, anchor, field, expected, got) where two indexes differ; both have operator, anchor, verdict, reason.

    A null anchor equals a null anchor. A row that one side lacks is one problem; a verdict that differs hides the
    reason; reasons are compared for refusals only, and but for white space.
    """
    a, b = reference.alias("a"), run.alias("b")
    both = a.join(b, (F.col("a.operator") == F.col("b.operator")) & F.col("a.anchor").eqNullSafe(F.col("b.anchor")), "full")
    lost, new = F.col("b.operator").isNull(), F.col("a.operator").isNull()
    want, got, say, said = (F.col(c) for c in ("a.verdict", "b.verdict", "a.reason", "b.reason"))
    differ = ~lost & ~new & (want != got)
    reason = ~lost & ~new & (want == got) & (want == "REFUSED") & (same_words(say) != same_words(said))
    field = F.when(lost | new, "row").when(differ, "verdict").when(reason, "reason")
    return both.select(
        F.coalesce("a.operator", "b.operator").alias("operator"),
        F.coalesce("a.anchor", "b.anchor").alias("anchor"),
        field.alias("field"),
        F.when(new, "<absent>").when(reason, same_words(say)).otherwise(want).alias("expected"),
        F.when(lost, "<absent>").when(reason, same_words(said)).otherwise(got).alias("got"),
    ).where("field is not null")


def remaining(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do: each key once, without those done."""
    return wanted.dropDuplicates(keys).join(done.select(*keys).distinct(), keys, "left_anti")


def with_corpus(records: DataFrame, corpus: DataFrame, key: str = "instance_id") -> DataFrame:
    """Each record with its task's columns of the corpus; a record whose task the corpus lacks stops the job and names it.

    The guard is part of the plan, in the one run that makes the result, and it holds whichever columns are asked for. A null key is
    lacking too. Of a task that the corpus has twice, each row counts; corpus columns named as the record's are left out.
    """
    own = corpus.select(key, *(c for c in corpus.columns if c not in records.columns), F.lit(True).alias("__known"))
    lacks = F.raise_error(F.concat(F.lit("the corpus lacks "), F.coalesce(F.col(key).cast("string"), F.lit("a null id")))).cast("boolean")
    return records.join(own, key, "left").where(F.when(F.col("__known"), True).otherwise(lacks)).drop("__known")


def unknown_ids(ids: DataFrame, corpus: DataFrame, key: str = "instance_id") -> DataFrame:
    """Ids that the corpus does not have."""
    return ids.join(corpus.select(key).distinct(), key, "left_anti")


def drift(original: DataFrame, repaired: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, item, change): items only one side has, as lost or gained; sets, so repetition does not count."""
    a, b = (x.select(*keys, item).distinct() for x in (original, repaired))
    lost = a.join(b, [*keys, item], "left_anti").withColumn("change", F.lit("lost"))
    return lost.unionByName(b.join(a, [*keys, item], "left_anti").withColumn("change", F.lit("gained")))


def agree(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that two implementations do not share, by multiplicity; none if they agree."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def presence(expected: DataFrame, statuses: DataFrame, keys: list[str], item: str = "test_id") -> DataFrame:
    """By keys: expected ids, those present in the log, and those failing; an absent id fails but is not present."""
    both = expected.join(statuses, [*keys, item], "left")
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("expected"), F.count("status").alias("present"), F.count_if(F.coalesce(F.col("status"), F.lit("ABSENT")) != "PASSED").alias("failing")
    )


def failing(statuses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, list, test_id) of every listed id that did not pass, as rows; an id without a status did not."""
    return statuses.where("not coalesce(status = 'PASSED', false)").select(*keys, "list", "test_id")


def grade(statuses: DataFrame, keys: list[str]) -> DataFrame:
    """Reward of a run from (keys, list, test_id, status): 1 if every listed id passed. Which ids fail is told by ``failing``."""
    ok = F.coalesce(F.col("status") == "PASSED", F.lit(False))

    def count(name: str, passed: bool) -> Column:
        return F.count_if((F.col("list") == name) & (ok if passed else ~ok)).alias(f"{name}_{'pass' if passed else 'fail'}")

    return statuses.groupBy(*keys).agg(
        count("f2p", True), count("f2p", False), count("p2p", True), count("p2p", False),
        F.min(ok.cast("double")).alias("reward"),
    )


def operator_grid(operators: DataFrame, targets: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every operator by target; one without an anchor is an explicit NOT_APPLICABLE row, not an absence."""
    grid = operators.crossJoin(targets)  # two short lists
    return grid.join(anchors, ["operator", "target"], "left").withColumn("status", F.when(F.col("anchor").isNull(), "NOT_APPLICABLE").otherwise("ANCHORED"))


def call_grid(arms: DataFrame, tasks: DataFrame, n_calls: int, calls: DataFrame) -> DataFrame:
    """Every arm, task and call; a call that failed or is missing stays with a null score."""
    numbers = arms.sparkSession.range(n_calls).select(F.col("id").cast("int").alias("call"))
    return arms.crossJoin(tasks).crossJoin(numbers).join(calls, ["arm", "task", "call"], "left")  # the plan of a run


def unowned(resident: DataFrame, leases: DataFrame, prefix: str) -> DataFrame:
    """Bytes resident under a prefix that no live lease holds."""
    own = resident.where(F.startswith("ref", F.lit(prefix))).join(leases.where("live").select("ref").distinct(), "ref", "left_anti")
    return own.agg(F.count(F.lit(1)).alias("images"), F.coalesce(F.sum("bytes"), F.lit(0).cast("long")).alias("bytes"))


def witness_side(rows: DataFrame) -> DataFrame:
    """Witness rows with the side of their evidence; p2p_failing, f2p_fail and coupled come from the grading."""
    p2p = F.array_intersect("p2p_failing", "coupled")
    side = (
        F.when(F.col("p2p_failing").isNull(), None)
        .when(F.size(p2p) > 0, "p2p_coupling")
        .when((F.size("p2p_failing") == 0) & (F.col("f2p_fail") > 0), "f2p_only")
        .otherwise("p2p_unattributed")
    )
    return rows.where("verdict = 'WITNESS'").withColumn("p2p_coupled_tests", p2p).withColumn("witness_side", side)


def verdict_of() -> Column:
    """The verdict lattice over control, anchored, refused, observable, valid and reward; a reward that is no finite number proves nothing."""
    reward = F.col("reward").cast("double")
    return (
        F.when(~F.coalesce(F.col("control"), F.lit(0.0)).eqNullSafe(1.0), "HARNESS_UNPROVEN")
        .when(~F.col("anchored"), "NOT_APPLICABLE")
        .when(F.col("refused"), "REFUSED")
        .when(~F.col("observable"), "UNVALIDATED")
        .when(F.col("valid").isNull(), "UNVALIDATED")
        .when(~F.col("valid"), "INVALID")
        .when(reward.isNull() | F.isnan(reward) | (F.abs(reward) == float("inf")), "UNVALIDATED")
        .when(reward == 0, "WITNESS")
        .otherwise("CLEAN")
    )


def task_verdict(rows: DataFrame) -> DataFrame:
    """False with any witness, true if anything was judged, else null: the third state is a value, not a gap."""
    out = rows.groupBy("instance_id").agg(F.max(F.col("verdict") == "WITNESS").alias("w"), F.max(F.col("verdict").isin(*JUDGED)).alias("j"))
    return out.select("instance_id", F.when(F.col("w"), False).when(F.col("j"), True).alias("form_clean"))


def tree_digest(files: DataFrame, keys: list[str], path: str = "path", text: str = "text", block: int = 2) -> DataFrame:
    """sha256 over the lines 'block  hash' of a tree, where each block's hash is sha256 over its lines 'hash  path' in path order.

    A missing text is a line 'MISSING path'. A block holds the paths whose sha256 begins with the same ``block`` hexadecimal
    digits, so the lines of one tree are spread over 16^block rows and never gathered into one; a tree's digest is made of the hashes of
    its blocks. Null where every text is missing.
    """
    line = F.when(F.col(text).isNull(), F.concat(F.lit("MISSING "), F.col(path))).otherwise(F.concat(F.sha2(text, 256), F.lit("  "), F.col(path)))

    def digest(order: str, value: str) -> Column:
        return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("p"), F.col(value).alias("l")))), lambda x: x["l"]), "\n"), 256)

    rows = files.select(*keys, F.substring(F.sha2(path, 256), 1, block).alias("block"), F.col(path).alias("p"), line.alias("l"), F.col(text).isNotNull().alias("there"))
    blocks = rows.groupBy(*keys, "block").agg(digest("p", "l").alias("hash"), F.count(F.lit(1)).alias("files"), F.count_if("there").alias("present"))
    blocks = blocks.withColumn("l", F.concat("hash", F.lit("  "), "block"))
    out = blocks.groupBy(*keys).agg(digest("block", "l").alias("digest"), F.sum("files").alias("files"), F.sum("present").alias("present"))
    return out.select(*keys, "files", F.when(F.col("present") > 0, F.col("digest")).alias("digest"))


def small_tree_digest(files: DataFrame, keys: list[str], order: str = "position", path: str = "path", text: str = "text") -> DataFrame:
    """sha256 over a tree's lines 'hash  path' or 'MISSING path' in the order given, joined by line ends: what sha256sum over the same paths gives.

    For trees that are a list of named paths, such as the files of a task: a tree's lines, not its texts, come to one row. ``tree_digest`` takes trees of any
    size, with another digest. Null where every text is missing, and where a path has no position or two share one.
    """
    line = F.when(F.col(text).isNull(), F.concat(F.lit("MISSING "), F.col(path))).otherwise(F.concat(F.sha2(text, 256), F.lit("  "), F.col(path)))
    rows = files.select(*keys, F.col(order).alias("o"), line.alias("l"), F.col(text).isNotNull().alias("there"))
    lines = F.sort_array(F.collect_list(F.struct("o", "l")))
    out = rows.groupBy(*keys).agg(lines.alias("x"), F.count(F.lit(1)).alias("files"), F.max("there").alias("there"))
    sound = F.col("there") & (F.size(F.array_compact(F.array_distinct(F.transform("x", lambda y: y["o"])))) == F.col("files"))
    return out.select(*keys, "files", F.when(sound, F.sha2(F.array_join(F.transform("x", lambda y: y["l"]), "\n"), 256)).alias("digest"))
