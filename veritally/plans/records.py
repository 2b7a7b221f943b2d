"""Records as JSON text, read with the explicit schema, and what is made of them; each with DuckDB SQL over the tables they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally import schemas
from veritally.operators import metrics
from veritally.plans.hosted import FACTS, RECORDS, ROWS, _read, _records, _rows, query
from veritally.sources import readers


def _json(spark: SparkSession, d: str) -> DataFrame:
    """A JSON text for each order, with its lineitems as verdict rows (seven at most) in the shape of a task's record."""
    lineitem = _read(spark, d, "lineitem")
    line = _rows(spark, d)
    rows = line.select("instance_id", F.struct("operator", "verdict", "loud_failure", "observable", "witness_side").alias("r"))
    listed = rows.groupBy("instance_id").agg(F.collect_list("r").alias("rows"))
    marks = lineitem.groupBy(F.col("l_orderkey").alias("instance_id")).agg(F.max(F.col("l_tax") == 0).alias("unparsed"))
    own = _records(spark, d).join(listed, "instance_id", "left").join(marks, "instance_id", "left")
    logs = F.when(F.col("unparsed"), F.array(F.lit("t"))).otherwise(F.array().cast("array<string>"))
    with_logs = F.transform("rows", lambda r: r.withField("failure_analysis", F.struct(logs.alias("unparsed"))))
    record = F.struct(
        F.col("instance_id").cast("string").alias("instance_id"), "repo", "multi_target", "n_targets", F.struct(F.col("control_passed").alias("passed")).alias("control"), with_logs.alias("rows"),
        F.filter("rows", lambda r: r["verdict"] == "WITNESS").alias("witnesses"), F.when(F.col("n_targets") < 3, F.col("control_passed")).alias("completed"),
    )
    return own.select(readers.once(F.to_json(record)).alias("value"))


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    return _json(spark, d).select(readers.once(F.from_json("value", schemas.RECORD)).alias("x")).select("x.*")


def _split(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return recs.select("instance_id", "repo", "multi_target", "n_targets", F.col("control.passed").alias("control_passed")), readers.verdict_rows(recs)


@query(f"""with {RECORDS}, {ROWS} select operator, verdict, count(*) as n from rs join records using (instance_id) where control_passed group by all""")
def json_verdict_counts(spark, d):
    return metrics.verdict_counts(*_split(_loaded(spark, d)))


@query(f"""with {RECORDS} select instance_id::varchar as instance_id from records where n_targets < 3 and control_passed""")
def json_complete_records(spark, d):
    return readers.complete(_loaded(spark, d)).select("instance_id")


@query(f"""with {ROWS} select distinct instance_id::varchar as instance_id from rs where verdict = 'WITNESS'""")
def json_witness_tasks(spark, d):
    return readers.witness_tasks(_loaded(spark, d))


@query(f"""with {ROWS}, u as (select distinct l_orderkey as instance_id from lineitem where l_tax = 0)
select operator, count(*) as rows, count(distinct instance_id) as tasks from rs join u using (instance_id) where verdict not in ('NOT_APPLICABLE', 'REFUSED') group by all""")
def unparsed_log_shapes(spark, d):
    return metrics.unparsed_logs(_split(_loaded(spark, d))[1])


@query("""select instance_id from (select o_orderkey as instance_id, o_custkey % 5 <> 0 as eligible from orders) where eligible""")
def eligible_listing(spark, d):
    lines = _read(spark, d, "orders").select(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("instance_id"), (F.col("o_custkey") % 5 != 0).alias("eligible"))).alias("value"))
    own = lines.select(F.from_json("value", schemas.ELIGIBLE).alias("x")).select("x.*").where("eligible")
    return own.select(F.col("instance_id").cast("long").alias("instance_id"))


@query("""select doc_id, len(w)::bigint as n_ids from (select doc_id, list_filter(string_split(lang || ',' || source, ','), lambda x: x <> '') as w from documents)""")
def coerced_lists(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.to_json(F.array("lang", "source")).alias("text"))
    return docs.select("doc_id", F.size(readers.string_list(F.col("text"))).cast("long").alias("n_ids"))


_CUT = "case when instance_id % 9 = 0 then 'no JSON object' when instance_id % 9 = 1 then 'no instance_id' when instance_id % 9 = 2 then 'empty' end"


@query(f"with {RECORDS} select instance_id, {_CUT} as broken from records")
def json_quarantine(spark, d):
    """Every record's text with some cut in half, without an id, or empty: what is whole and what is told as broken."""
    k, value = F.col("instance_id"), F.col("value")
    texts = _json(spark, d).withColumn("instance_id", F.get_json_object("value", "$.instance_id").cast("long"))
    half = F.substr(value, F.lit(1), F.floor(F.length(value) / 2).cast("int"))
    hurt = F.when(k % 9 == 0, half).when(k % 9 == 1, F.replace(value, F.lit('"instance_id":'), F.lit('"other_id":'))).when(k % 9 == 2, F.lit(" ")).otherwise(value)
    told = readers.told_records(texts.select(k.alias("own_id"), readers.once(hurt).alias("value")))
    return told.select(F.when(F.col("broken").isNull(), F.col("record.instance_id").cast("long")).otherwise(F.col("own_id")).alias("instance_id"), "broken")


_SETS = f"""{FACTS}, f as (select operator, instance_id, repo, case when own.multi_target then 'multi' else 'single' end as targets, bool_or(verdict in ('WITNESS', 'CLEAN', 'INVALID')) as j, bool_or(verdict = 'WITNESS') as w
  from own join (select instance_id, repo from records) using (instance_id) group by all),
g as (select operator, repo, targets, count(*) filter (where j) as n, count(*) filter (where j and w) as k from f group by grouping sets ((operator), (operator, repo), (operator, targets))),
h as (select operator, case when repo is not null then 'repo' when targets is not null then 'targets' end as grouping, coalesce(repo, targets) as value, n, k from g),
m as (select operator, grouping, median(case when n > 0 then k::double / n end) as median from h where grouping is not null group by all),
s as (select operator, case when grouping is null then 'all' else 'only' end as subset, grouping, value, n, k from h
  union all select h.operator, 'without', h.grouping, h.value, t.n - h.n, t.k - h.k from h join h t on t.operator = h.operator and t.grouping is null where h.grouping is not null),
r as (select s.*, m.median, case when n > 0 then k::double / n end as rate, 1 + 1.96::double * 1.96 / n as dd from s left join m using (operator, grouping))"""


@query(f"""with {_SETS} select operator, subset, grouping, value, n as judged_tasks, k as witness_tasks, round_even(rate, 4) as rate,
round_even(greatest(0, case when n > 0 then (rate + 1.96::double * 1.96 / (2 * n) - 1.96::double * sqrt(rate * (1 - rate) / n + 1.96::double * 1.96 / (4 * n * n))) / dd end), 4) as wilson_low,
round_even(least(1, case when n > 0 then (rate + 1.96::double * 1.96 / (2 * n) + 1.96::double * sqrt(rate * (1 - rate) / n + 1.96::double * 1.96 / (4 * n * n))) / dd end), 4) as wilson_high, median from r""")
def rate_sensitivity(spark, d):
    groups = {"repo": F.col("repo"), "targets": F.when(F.col("multi_target"), "multi").otherwise("single")}
    return metrics.sensitivity(_records(spark, d), _rows(spark, d), groups)
