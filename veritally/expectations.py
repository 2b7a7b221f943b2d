"""Guards on data: each raises when it is broken, inside the plan or on a bounded result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class ExpectationError(ValueError):
    """Data does not hold what a result relies on."""


def expect(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """df with a check in its plan: the query fails at the first row for which ``holds`` is not true."""
    first = df.columns[0]
    checked = F.when(F.coalesce(holds, F.lit(False)), F.col(first)).otherwise(F.raise_error(F.lit(message)))
    return df.withColumn(first, checked.cast(df.schema[first].dataType))


class Watch:
    """Conditions that are counted while a result is made, so that a guard costs no job of its own.

    ``on`` attaches them to a DataFrame's plan; once that has been run by an action, ``settle`` raises if any row broke one. Null is not true.
    """

    def __init__(self, **holds: Column):
        self.holds = holds
        self.seen = Observation()

    def on(self, df: DataFrame) -> DataFrame:
        """df, whose next run is watched; once for a watch."""
        broken = [F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in self.holds.items()]
        return df.observe(self.seen, F.count(F.lit(1)).alias("rows"), *broken)

    def settle(self) -> dict[str, int]:
        """The counts of the run: rows, and how many broke each condition; an error if any did."""
        counts = self.seen.get
        if bad := {n: c for n, c in counts.items() if n != "rows" and c}:
            raise ExpectationError(f"broken by rows: {bad} of {counts['rows']}")
        return counts


def watched_ids(rows: DataFrame, corpus: DataFrame, key: str = "instance_id") -> tuple[DataFrame, Watch]:
    """rows joined to the corpus, and a watch that tells after one run whether an id was not in it."""
    known = rows.join(corpus.withColumn("_known", F.lit(True)), key, "left")
    watch = Watch(known_ids=F.col("_known"))
    return watch.on(known).drop("_known"), watch


def expect_none(bad: DataFrame, message: str) -> None:
    """An error with examples if there is any row."""
    if rows := bad.limit(5).collect():
        raise ExpectationError(f"{message}: {[tuple(r) for r in rows]}")


def known_ids(ids: DataFrame, corpus: DataFrame, key: str = "instance_id") -> None:
    """Every id has to be in the corpus."""
    expect_none(ids.join(corpus.select(key), key, "left_anti"), "unknown ids")


def no_burn(burns: DataFrame) -> None:
    """No run may burn through its queue."""
    expect_none(burns, "outcomes too fast to have run")


def rate_has_operator(report: object) -> None:
    """No rate in a report without its operator, however deep; a null rate is allowed."""
    if isinstance(report, dict):
        if report.get("rate") is not None and not report.get("operator"):
            raise ExpectationError("a rate without an operator")
        for x in report.values():
            rate_has_operator(x)
    elif isinstance(report, list | tuple):
        for x in report:
            rate_has_operator(x)


def overlay_in_scope(touched: list[str], test_files: list[str], production: list[str]) -> None:
    """An overlay is not empty, stays within the test files, and touches no production file."""
    if not touched:
        raise ExpectationError("the overlay is empty")
    if outside := sorted(set(touched) - set(test_files)):
        raise ExpectationError(f"the overlay leaves the test files: {outside}")
    if bad := sorted(set(touched) & set(production)):
        raise ExpectationError(f"the overlay touches production: {bad}")


def pinned(text: str, digest: str | None) -> None:
    """A baseline has its pinned hash; a missing pin is an error too."""
    import hashlib

    if not digest:
        raise ExpectationError("the baseline has no pin")
    if hashlib.sha256(text.encode()).hexdigest() != digest.strip():
        raise ExpectationError("the baseline differs from its pin")


def complete_digest(lines: int, expected: int, missing: int) -> None:
    """A tree digest has a line for each path, and not all of them missing."""
    if lines != expected:
        raise ExpectationError(f"{lines} digest lines for {expected} paths")
    if expected and missing == expected:
        raise ExpectationError("every path is missing")


def within_cost(projected: float, ceiling: float) -> None:
    """A run's projected cost stays under its ceiling."""
    if not projected <= ceiling:
        raise ExpectationError(f"projected cost {projected} is over {ceiling}")


def enough_controlled(n: int, least: int = 40) -> None:
    """A sample with too few controlled tasks is invalid."""
    if n < least:
        raise ExpectationError(f"{n} controlled tasks; {least} are needed")


def payloads_constant(calls: DataFrame) -> None:
    """An arm's calls for a task send one payload."""
    from veritally.operators.judge import payload_constancy

    expect_none(payload_constancy(calls), "payloads differ")
