"""The audit report: bounded aggregates, put together on the driver and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame

from veritally.expectations import rate_has_operator
from veritally.operators import metrics
from veritally.sources.readers import verdict_rows


def build(recs: DataFrame) -> dict:
    """All metrics of loaded records; each list has a row per operator, verdict or stratum, never one per task."""
    from pyspark.sql import functions as F

    records = recs.select("instance_id", "repo", "multi_target", "n_targets", F.col("control.passed").alias("control_passed")).cache()
    rows = verdict_rows(recs).cache()
    rows_of = lambda df: [r.asDict() for r in df.collect()]
    try:
        report = {
            **records_row(records),
            "by_operator_rate": rows_of(metrics.witness_rate(records, rows).orderBy("operator")),
            "by_target_group": rows_of(metrics.witness_rate_by_stratum(records, rows).orderBy("stratum", "operator")),
            "anchor_availability": rows_of(metrics.anchor_availability(records, rows).orderBy("operator")),
            "verdicts": rows_of(metrics.verdict_counts(records, rows).orderBy("operator", "verdict")),
            "loud_silent": rows_of(metrics.loud_silent(records, rows).orderBy("part")),
            "witness_split": rows_of(metrics.witness_split(rows).orderBy("side")),
            "coupling": rows_of(metrics.coupling_types(rows).orderBy("coupling")),
            "unparsed_log_shapes": rows_of(metrics.unparsed_logs(rows).orderBy("operator")),
        }
    finally:
        records.unpersist()
        rows.unpersist()
    rate_has_operator(report)
    return report


def records_row(records: DataFrame) -> dict:
    """The report's single counts."""
    return metrics.record_counts(records).first().asDict()
