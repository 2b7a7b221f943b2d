"""The audit's operators as queries over the driver's tables, each with DuckDB SQL for the same rows.

The tables stand in for an audit's data: orders for records, lineitem for verdict rows, events for event logs and
judge calls, documents for eligibility lists and texts. Diffs, logs and gate matrices are small literals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions import expressions as X
from veritally.operators import compare, events, gates, judge, metrics, sampling, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("instance_id"), F.col("o_orderpriority").alias("repo"), (F.col("o_orderstatus") != "P").alias("control_passed"),
        (F.col("o_custkey") % 7 == 0).alias("multi_target"), (1 + F.when(F.col("o_custkey") % 7 == 0, F.col("o_custkey") % 3 + 1).otherwise(0)).cast("int").alias("n_targets"),
    )


def _rows(spark: SparkSession, d: str) -> DataFrame:
    c = F.round(F.col("l_discount") * 100).cast("int")
    verdict = (
        F.when(c == 0, "WITNESS").when(c <= 2, "CLEAN").when(c == 3, "INVALID").when(c == 4, "UNVALIDATED").when(c <= 7, "REFUSED").otherwise("NOT_APPLICABLE")
    )
    side = F.when(F.col("l_quantity") < 10, "p2p_coupling").when(F.col("l_quantity") < 30, "f2p_only").when(F.col("l_quantity") < 45, "p2p_unattributed")
    return _read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("instance_id"), F.col("l_returnflag").alias("operator"), verdict.alias("verdict"), (F.col("l_linestatus") == "F").alias("loud_failure"),
        F.concat(F.lit("w"), (F.col("l_linenumber") % 4).cast("string")).alias("observable"), side.alias("witness_side"), (F.col("l_partkey") % 11).alias("p"),
    )


RECORDS = """records as (select o_orderkey as instance_id, o_orderpriority as repo, o_orderstatus <> 'P' as control_passed, o_custkey % 7 = 0 as multi_target,
  (1 + case when o_custkey % 7 = 0 then o_custkey % 3 + 1 else 0 end)::int as n_targets from orders)"""
ROWS = """rs as (select l_orderkey as instance_id, l_returnflag as operator, l_linestatus = 'F' as loud_failure, 'w' || (l_linenumber % 4)::varchar as observable,
  case c when 0 then 'WITNESS' when 1 then 'CLEAN' when 2 then 'CLEAN' when 3 then 'INVALID' when 4 then 'UNVALIDATED' when 5 then 'REFUSED' when 6 then 'REFUSED'
    when 7 then 'REFUSED' else 'NOT_APPLICABLE' end as verdict,
  case when l_quantity < 10 then 'p2p_coupling' when l_quantity < 30 then 'f2p_only' when l_quantity < 45 then 'p2p_unattributed' end as witness_side, l_partkey % 11 as p
  from (select *, round(l_discount * 100)::int as c from lineitem))"""
FACTS = f"{RECORDS}, {ROWS}, own as (select rs.*, multi_target from rs join records using (instance_id) where control_passed)"
RATE = """, t as (select operator{by}, instance_id, bool_or(verdict in ('WITNESS', 'CLEAN', 'INVALID')) as j, bool_or(verdict = 'WITNESS') as w from own group by all),
c as (select operator{by}, count(*) filter (where j) as n, count(*) filter (where j and w) as k from t group by all),
r as (select *, case when n > 0 then k::double / n end as rate, 1 + 1.96::double * 1.96 / n as dd from c)
select operator{by}, n as judged_tasks, k as witness_tasks, round_even(rate, 4) as rate,
  round_even(case when rate is not null then greatest(0.0::double, (rate + 1.96::double * 1.96 / (2 * n)) / dd - 1.96::double * sqrt(rate * (1 - rate) / n + 1.96::double * 1.96 / (4.0::double * n * n)) / dd) end, 4) as wilson_low,
  round_even(case when rate is not null then least(1.0::double, (rate + 1.96::double * 1.96 / (2 * n)) / dd + 1.96::double * sqrt(rate * (1 - rate) / n + 1.96::double * 1.96 / (4.0::double * n * n)) / dd) end, 4) as wilson_high"""


@query(f"with {FACTS}{RATE.format(by='')} from r")
def witness_rate_by_operator(spark, d):
    return metrics.witness_rate(_records(spark, d), _rows(spark, d))


_STRATUM = FACTS.replace("multi_target from rs", "case when multi_target then 'multi' else 'single' end as stratum from rs")


@query(
    f"with {_STRATUM}, sizes as (select case when multi_target then 'multi' else 'single' end as stratum, count(*) as tasks from records group by all)"
    f"{RATE.format(by=', stratum')}, tasks from r join sizes using (stratum)"
)
def witness_rate_by_stratum(spark, d):
    return metrics.witness_rate_by_stratum(_records(spark, d), _rows(spark, d))


@query(f"""with {FACTS}, t as (select operator, instance_id, bool_or(verdict <> 'NOT_APPLICABLE') as a from own group by all)
select operator, count(*) as tasks, count(*) filter (where a) as with_anchor, round_even((count(*) filter (where a))::double / count(*), 4) as availability from t group by operator""")
def anchor_availability(spark, d):
    return metrics.anchor_availability(_records(spark, d), _rows(spark, d))


@query(f"with {FACTS} select operator, verdict, count(*) as n from own group by all")
def verdict_counts(spark, d):
    return metrics.verdict_counts(_records(spark, d), _rows(spark, d))


@query(f"""with {FACTS} select case when loud_failure then 'loud' else 'silent' end as part, count(*) filter (where verdict in ('WITNESS', 'CLEAN', 'INVALID')) as judged,
count(*) filter (where verdict = 'WITNESS') as witnesses, string_agg(distinct operator, ',' order by operator) as operators from own group by all""")
def loud_silent(spark, d):
    return metrics.loud_silent(_records(spark, d), _rows(spark, d))


@query(f"""with {ROWS}, s(side) as (values ('p2p_coupling'), ('f2p_only'), ('p2p_unattributed'), ('unknown')),
c as (select coalesce(witness_side, 'unknown') as side, count(*) as n from rs where verdict = 'WITNESS' group by all) select side, coalesce(n, 0) as n from s left join c using (side)""")
def witness_split(spark, d):
    return metrics.witness_split(_rows(spark, d))


@query(f"with {ROWS} select operator || '::' || observable as coupling, count(*) as n from rs where verdict = 'WITNESS' group by all")
def coupling_types(spark, d):
    return metrics.coupling_types(_rows(spark, d))


@query(f"""with {RECORDS} select count(*) as n_records, count(*) filter (where control_passed) as n_controlled, count(*) filter (where not control_passed) as n_control_failed,
count(*) filter (where control_passed and multi_target) as n_multi_target from records""")
def control_failures(spark, d):
    return metrics.record_counts(_records(spark, d))


@query(f"with {RECORDS} select n_targets, count(*) as n from records group by all")
def target_histogram(spark, d):
    return metrics.target_histogram(_records(spark, d))


@query("""with e as (select doc_id % 5 <> 0 as eligible, doc_id % 7 <> 0 as single_file from documents)
select count(*) as n, count(*) filter (where eligible) as n_eligible, count(*) filter (where eligible and single_file) as n_single_file,
round_even((count(*) filter (where eligible and single_file))::double / nullif(count(*) filter (where eligible), 0), 4) as share_single_file from e""")
def eligibility_summary(spark, d):
    docs = _read(spark, d, "documents")
    return metrics.eligibility_summary(docs.select((F.col("doc_id") % 5 != 0).alias("eligible"), (F.col("doc_id") % 7 != 0).alias("single_file")))


@query("""with o as (select o_orderkey, o_orderstatus as s, o_custkey % 13 as failing, (o_custkey % 13 + o_orderkey % 5)::int as graded from orders),
b as (select *, 100.0::double * failing / nullif(graded, 0) as x from o where graded > 0)
select case when x >= 100 then '100%' when x >= 50 then '50-99%' when x >= 20 then '20-49%' when x >= 5 then '5-19%' else '<5%' end as bin, count(*) as tasks,
sum(failing)::bigint as failing, sum(graded)::bigint as graded from b group by all""")
def suite_loss_bins(spark, d):
    o = _read(spark, d, "orders")
    return metrics.suite_loss(o.select((F.col("o_custkey") % 13).alias("failing"), (F.col("o_custkey") % 13 + F.col("o_orderkey") % 5).cast("int").alias("graded")))


@query(f"""with {ROWS} select case when p < 4 then 'mentioned' when p < 7 then 'literal' when loud_failure then 'span' else 'other' end as class, count(*) as rows,
count(distinct instance_id) as tasks from rs where verdict = 'REFUSED' group by all""")
def refusal_classes(spark, d):
    classes = {"mentioned": F.col("p") < 4, "literal": F.col("p") < 7, "span": F.col("loud_failure")}
    return metrics.refusal_classes(_rows(spark, d), classes)


@query(f"with {ROWS} select p, count(*) as n from rs where verdict = 'REFUSED' group by all order by n desc, p limit 5")
def top_symbols(spark, d):
    return metrics.top_values(_rows(spark, d).where("verdict = 'REFUSED'"), "p", 5)


@query("""select event_type, count(*) filter (where value > 50) as n_true, count(*) as n, (count(*) filter (where value > 50))::double / count(*) as share from events group by all""")
def mount_rate(spark, d):
    return metrics.share_true(_read(spark, d, "events").withColumn("mounted", F.col("value") > 50), "mounted", "event_type")


# ---- comparison and joins

INDEX = """i as (select l_linestatus as side, l_returnflag as operator, case when l_partkey % 5 = 0 then null else l_partkey end as anchor, l_orderkey as o, l_linenumber as n,
  l_shipdate as s, l_discount as v, l_quantity as q from lineitem),
x as (select side, operator, anchor, max((o, n, s, v, q)) as m from i group by all),
idx as (select side, operator, anchor, case when m[4] <= 0.03 then 'REFUSED' else 'CLEAN' end as verdict, 'why  ' || (m[5]::int % 3)::varchar as reason from x)"""


def _index(spark: SparkSession, d: str, side: str) -> DataFrame:
    line = _read(spark, d, "lineitem").where(F.col("l_linestatus") == side)
    own = line.select(
        F.col("l_returnflag").alias("operator"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey")).alias("anchor"),
        F.struct("l_orderkey", "l_linenumber", "l_shipdate", "l_discount", "l_quantity").alias("ordinal"),
        F.when(F.col("l_discount") <= 0.03, "REFUSED").otherwise("CLEAN").alias("verdict"),
        F.concat(F.lit("why  "), (F.col("l_quantity").cast("int") % 3).cast("string")).alias("reason"),
    )
    return compare.last_of(own, ["operator", "anchor"], "ordinal")


@query(f"""with {INDEX}, a as (select * from idx where side = 'F'), b as (select * from idx where side = 'O'),
j as (select coalesce(a.operator, b.operator) as operator, coalesce(a.anchor, b.anchor) as anchor, a.operator is null as new, b.operator is null as lost,
  a.verdict as av, b.verdict as bv, trim(regexp_replace(a.reason, '\\s+', ' ', 'g')) as ar, trim(regexp_replace(b.reason, '\\s+', ' ', 'g')) as br
  from a full join b on a.operator = b.operator and a.anchor is not distinct from b.anchor),
f as (select *, case when new or lost then 'row' when av <> bv then 'verdict' when av = 'REFUSED' and ar <> br then 'reason' end as field from j)
select operator, anchor, field, case when new then '<absent>' when field = 'reason' then ar else av end as expected,
case when lost then '<absent>' when field = 'reason' then br else bv end as got from f where field is not null""")
def verdict_diff(spark, d):
    return compare.verdict_diff(_index(spark, d, "F"), _index(spark, d, "O"))


@query(f"with {INDEX} select operator, verdict, count(*) as n from idx where side = 'F' group by all")
def verdict_index_counts(spark, d):
    return _index(spark, d, "F").groupBy("operator", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey as instance_id, o_custkey as task from orders anti join (select l_orderkey as o_orderkey from lineitem where l_discount < 0.05) using (o_orderkey)")
def resume_remaining(spark, d):
    wanted = _read(spark, d, "orders").select(F.col("o_orderkey").alias("instance_id"), F.col("o_custkey").alias("task"))
    done = _read(spark, d, "lineitem").where("l_discount < 0.05").select(F.col("l_orderkey").alias("instance_id"))
    return compare.remaining(wanted, done, ["instance_id"])


@query("select distinct doc_id + 500 as instance_id from documents where doc_id + 500 not in (select doc_id from documents)")
def unknown_ids(spark, d):
    docs = _read(spark, d, "documents")
    return compare.unknown_ids(docs.select((F.col("doc_id") + 500).alias("instance_id")).distinct(), docs.select(F.col("doc_id").alias("instance_id")))


@query("""with f as (select distinct l_returnflag as task, l_suppkey as failing, l_linestatus as variant from lineitem)
select task, failing, 'lost' as change from f a where variant = 'F' and not exists (select 1 from f b where b.variant = 'O' and a.task = b.task and a.failing = b.failing)
union all select task, failing, 'gained' from f a where variant = 'O' and not exists (select 1 from f b where b.variant = 'F' and a.task = b.task and a.failing = b.failing)""")
def gate_drift(spark, d):
    own = _read(spark, d, "lineitem").select(F.col("l_returnflag").alias("task"), F.col("l_suppkey").alias("failing"), "l_linestatus")
    return compare.drift(own.where("l_linestatus = 'F'"), own.where("l_linestatus = 'O'"), ["task"], "failing")


@query("""with e as (select distinct l_returnflag as run, l_partkey * 2 + l_linenumber % 2 as test_id from lineitem), s as (select p_partkey * 2 as test_id, p_size from part)
select run, count(*) as expected, count(p_size) as present, count(*) filter (where coalesce(p_size, 99) > 25) as failing from e left join s using (test_id) group by all""")
def id_presence(spark, d):
    expected = _read(spark, d, "lineitem").select(F.col("l_returnflag").alias("run"), (F.col("l_partkey") * 2 + F.col("l_linenumber") % 2).alias("test_id")).distinct()
    status = F.when(F.col("p_size") > 25, "FAILED").otherwise("PASSED").alias("status")
    part = _read(spark, d, "part").select((F.col("p_partkey") * 2).alias("test_id"), status)
    return compare.presence(expected, expected.select("run").distinct().crossJoin(part), ["run"])  # three runs


@query("""with s as (select o_custkey % 50 as run, case when o_orderkey % 3 = 0 then 'f2p' else 'p2p' end as list, o_orderkey::varchar as test_id, o_totalprice > 20000 as ok from orders)
select run, count(*) filter (where list = 'f2p' and ok) as f2p_pass, count(*) filter (where list = 'f2p' and not ok) as f2p_fail, count(*) filter (where list = 'p2p' and ok) as p2p_pass,
count(*) filter (where list = 'p2p' and not ok) as p2p_fail, min(ok::int)::double as reward from s group by run""")
def grade_runs(spark, d):
    o = _read(spark, d, "orders")
    own = o.select(
        (F.col("o_custkey") % 50).alias("run"), F.when(F.col("o_orderkey") % 3 == 0, "f2p").otherwise("p2p").alias("list"), F.col("o_orderkey").cast("string").alias("test_id"),
        F.when(F.col("o_totalprice") > 20000, "PASSED").otherwise("FAILED").alias("status"),
    )
    return compare.grade(own, ["run"])


@query("select o_custkey % 50 as run, case when o_orderkey % 3 = 0 then 'f2p' else 'p2p' end as list, o_orderkey::varchar as test_id from orders where not o_totalprice > 20000")
def failing_ids(spark, d):
    o = _read(spark, d, "orders")
    own = o.select(
        (F.col("o_custkey") % 50).alias("run"), F.when(F.col("o_orderkey") % 3 == 0, "f2p").otherwise("p2p").alias("list"), F.col("o_orderkey").cast("string").alias("test_id"),
        F.when(F.col("o_totalprice") > 20000, "PASSED").otherwise("FAILED").alias("status"),
    )
    return compare.failing(own, ["run"])


@query("""with o as (select distinct l_returnflag as operator from lineitem), t as (select n_nationkey as target from nation),
a as (select l_returnflag as operator, l_suppkey % 25 as target, min(l_partkey) as anchor from lineitem group by all)
select operator, target, anchor, case when anchor is null then 'NOT_APPLICABLE' else 'ANCHORED' end as status from o cross join t left join a using (operator, target)""")
def operator_grid(spark, d):
    line = _read(spark, d, "lineitem")
    targets = _read(spark, d, "nation").select(F.col("n_nationkey").alias("target"))
    own = line.groupBy(F.col("l_returnflag").alias("operator"), (F.col("l_suppkey") % 25).alias("target"))
    return compare.operator_grid(line.select(F.col("l_returnflag").alias("operator")).distinct(), targets, own.agg(F.min("l_partkey").alias("anchor")))


@query("""with r as (select 'ns/' || p_brand as ref, p_size::bigint as bytes from part), l as (select distinct 'ns/' || p_brand as ref from part where p_size = 50)
select count(*) as images, coalesce(sum(bytes), 0)::bigint as bytes from r where ref not in (select ref from l)""")
def unowned_footprint(spark, d):
    part = _read(spark, d, "part").select(F.concat(F.lit("ns/"), "p_brand").alias("ref"), F.col("p_size").cast("long").alias("bytes"))
    return compare.unowned(part, part.where("bytes = 50").select("ref", F.lit(True).alias("live")), "ns/")


@query(r"""with f as (select source, lpad(doc_id::varchar, 12, '0') as path, case when doc_id % 17 = 0 then null else text end as text from documents),
l as (select source, path, left(sha256(path), 2) as block, case when text is null then 'MISSING ' || path else sha256(text) || '  ' || path end as line, text is not null as there from f),
b as (select source, block, sha256(string_agg(line, chr(10) order by path)) || '  ' || block as line, count(*) as n, bool_or(there) as there from l group by source, block)
select source, sum(n)::bigint as files, case when bool_or(there) then sha256(string_agg(line, chr(10) order by block)) end as digest from b group by source""")
def tree_digest(spark, d):
    docs = _read(spark, d, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.when(F.col("doc_id") % 17 != 0, F.col("text")).alias("text"))
    return compare.tree_digest(docs, ["source"])


@query("""select l_orderkey as instance_id, l_returnflag as operator, o_orderpriority as repo, count(*)::bigint as n_rows, sum(case when o_custkey % 10 = 0 then 0 else 1 end)::bigint as controlled
from lineitem join orders on l_orderkey = o_orderkey group by all""")
def record_corpus(spark, d):
    records = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("instance_id"), F.col("l_returnflag").alias("operator"))
    corpus = _read(spark, d, "orders").select(F.col("o_orderkey").alias("instance_id"), F.col("o_orderpriority").alias("repo"), (F.col("o_custkey") % 10 != 0).alias("passed"))
    both = compare.with_corpus(records, corpus)
    return both.groupBy("instance_id", "operator", "repo").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("passed").alias("controlled"))


@query(r"""with f as (select l_orderkey as task, l_linenumber as position, 'part/' || l_partkey || '.py' as path, case when l_quantity > 25 then l_returnflag || l_linestatus || l_suppkey end as text from lineitem)
select task, count(*)::bigint as files, case when bool_or(text is not null) and count(distinct position) = count(*) then sha256(string_agg(case when text is null then 'MISSING ' || path else sha256(text) || '  ' || path end, chr(10) order by position)) end as digest
from f group by task""")
def task_digest(spark, d):
    text = F.when(F.col("l_quantity") > 25, F.concat("l_returnflag", "l_linestatus", F.col("l_suppkey").cast("string"))).alias("text")
    files = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("position"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("path"), text)
    return compare.small_tree_digest(files, ["task"])


@query("""with v as (select o_orderkey as instance_id, case when o_orderstatus = 'P' then 0.5 else 1.0 end as control, o_custkey % 5 <> 0 as anchored, o_custkey % 7 = 1 as refused,
o_custkey % 11 <> 2 as observable, case o_custkey % 3 when 0 then true when 1 then false end as valid,
case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then 'nan'::double else (o_orderkey % 2)::double end as reward from orders)
select instance_id, case when control <> 1.0 then 'HARNESS_UNPROVEN' when not anchored then 'NOT_APPLICABLE' when refused then 'REFUSED' when not observable then 'UNVALIDATED'
when valid is null then 'UNVALIDATED' when not valid then 'INVALID' when reward is null or isnan(reward) then 'UNVALIDATED' when reward = 0 then 'WITNESS' else 'CLEAN' end as verdict from v""")
def verdict_lattice(spark, d):
    k = F.col("o_custkey")
    o = _read(spark, d, "orders").select(
        F.col("o_orderkey").alias("instance_id"), F.when(F.col("o_orderstatus") == "P", 0.5).otherwise(1.0).alias("control"), (k % 5 != 0).alias("anchored"),
        (k % 7 == 1).alias("refused"), (k % 11 != 2).alias("observable"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("valid"),
        F.when(F.col("o_orderkey") % 5 > 1, (F.col("o_orderkey") % 2).cast("double")).when(F.col("o_orderkey") % 5 == 1, float("nan")).alias("reward"),
    )
    return o.select("instance_id", compare.verdict_of().alias("verdict"))


@query(f"""with {ROWS}, t as (select instance_id, bool_or(verdict = 'WITNESS') as w, bool_or(verdict in ('WITNESS', 'CLEAN', 'INVALID')) as j from rs group by all)
select case when w then false when j then true end as form_clean, count(*) as n from t group by all""")
def task_verdicts(spark, d):
    return compare.task_verdict(_rows(spark, d)).groupBy("form_clean").agg(F.count(F.lit(1)).alias("n"))


# ---- sampling

ROBIN = "select doc_id as instance_id, source from (select doc_id, source, row_number() over (partition by source order by doc_id) as r, min(doc_id) over (partition by source) as f from documents) order by r, f limit 50"


@query(ROBIN)
def round_robin_select(spark, d):
    return sampling.round_robin(_read(spark, d, "documents").select(F.col("doc_id").alias("instance_id"), "source"), 50, "source", "instance_id")


@query("""with c as (select o_orderpriority as repo, count(*) as n from orders group by all), e as (select repo, n, n * 101 / sum(n) over ()::double as x from c)
select repo, n, (floor(x) + (row_number() over (order by x - floor(x) desc, repo) <= 101 - sum(floor(x)) over ())::int)::bigint as quota from e""")
def largest_remainder_quota(spark, d):
    counts = _read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("repo")).agg(F.count(F.lit(1)).alias("n"))
    return sampling.allocate(counts, 101, [], "repo")


@query("""with t as (select doc_id as instance_id, case when doc_id % 7 = 0 then 'multi' else 'single' end as stratum, lang as grp from documents),
o as (select stratum, n, n * 60 / sum(n) over ()::double as x from (select stratum, count(*) as n from t group by all)),
oq as (select stratum, floor(x) + (row_number() over (order by x - floor(x) desc, stratum) <= 60 - sum(floor(x)) over ())::int as want from o),
i as (select stratum, grp, n, want, n * want / (sum(n) over (partition by stratum))::double as x from (select stratum, grp, count(*) as n from t group by all) join oq using (stratum)),
iq as (select stratum, grp, floor(x) + (row_number() over (partition by stratum order by x - floor(x) desc, grp) <= want - sum(floor(x)) over (partition by stratum))::int as quota from i),
k as (select t.*, quota, row_number() over (partition by stratum, grp order by sha256('20260908|' || instance_id::varchar), instance_id) as r from t join iq using (stratum, grp))
select instance_id, stratum, grp from k where r <= quota""")
def stratified_sample(spark, d):
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("instance_id"), F.when(F.col("doc_id") % 7 == 0, "multi").otherwise("single").alias("stratum"), F.col("lang").alias("grp"))
    return sampling.stratified(docs, 60, 20260908, "stratum", "grp")


@query("select instance_id from (select doc_id as instance_id from documents order by sha256('5|' || doc_id::varchar), doc_id limit 40) order by 1")
def seeded_limit(spark, d):
    return sampling.seeded_limit(_read(spark, d, "documents").select(F.col("doc_id").alias("instance_id")), 40, 5)


# ---- events


@query("""with w as (select user_id as run, ts, event_id, value as seconds, max(value) over p as slowest, count(*) over p as n from events
window p as (partition by user_id order by ts, event_id rows between 7 preceding and current row)) select run, event_id, seconds, slowest from w where n = 8 and slowest < 60""")
def burn_windows(spark, d):
    own = _read(spark, d, "events").select(F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("seconds"))
    return events.burns(own, under=60.0).drop("ts")


@query("""with e as (select user_id as run, ts, event_id, value > 20 as refused from events), i as (select *, sum((not refused)::int) over (partition by run order by ts, event_id) as g from e),
c as (select run, ts, event_id, refused, row_number() over (partition by run, g order by ts, event_id) as consecutive from i where refused)
select run, event_id, refused, consecutive::int as consecutive, (case when consecutive < 3 then 0 else least(900.0, 60 * pow(2.0, consecutive - 3)) end)::int as sleep_s from c""")
def refusal_backoff(spark, d):
    own = _read(spark, d, "events").select(F.col("user_id").alias("run"), "ts", "event_id", (F.col("value") > 20).alias("refused"))
    return events.backoffs(own).drop("ts")


# ---- judge

CALLS = """calls as (select event_type as arm, user_id % 10 as task, event_id as call, case when k < 95 then (k % 11)::int end as score, k = 99 as output_cap_hit
  from (select *, json_extract_string(props, '$.k')::int as k from events))"""
SPREAD = f"""{CALLS}, s as (select arm, task, count(score) as n, count(*) filter (where score is null) as parse_failures, min(score) as least, max(score) as most,
  avg(score) as mean, case when count(score) = 1 then 0.0 else stddev_samp(score) end as stdev, max(score) - min(score) as observed_range,
  case when count(score) >= {{n}} then max(score) - min(score) end as range from calls group by all)"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return _read(spark, d, "events").select(
        F.col("event_type").alias("arm"), (F.col("user_id") % 10).alias("task"), F.col("event_id").alias("call"), F.when(k < 95, k % 11).alias("score"), (k == 99).alias("output_cap_hit")
    )


@query(f"with {SPREAD.format(n=150)} select arm, task, n, parse_failures, least, most, round(mean, 9) as mean, round(stdev, 9) as stdev, observed_range, range from s")
def judge_spread(spark, d):
    return judge.spread(_calls(spark, d), 150).withColumn("mean", F.round("mean", 9)).withColumn("stdev", F.round("stdev", 9))


ARMS = f"""{SPREAD.format(n=150)}, a as (select arm, count(range) as counting_tasks, count(range) >= 8 as covered, case when count(range) >= 8 then median(range) end as median_range,
  case when count(range) >= 8 then max(range) end as max_range, count(*) filter (where range = 0) as tasks_with_range_0, sum(parse_failures)::bigint as parse_failures from s group by arm)"""


@query(f"with {ARMS} select * from a")
def judge_arm_aggregate(spark, d):
    return judge.arm_aggregate(judge.spread(_calls(spark, d), 150), 8)


CHECK = f"""c as (select count(*) as calls, count(score) as usable, count(*) filter (where output_cap_hit) as cap_hits, count(score)::double / count(*) as parse_rate from calls),
  i as (select *, cap_hits > 0 as void, cap_hits = 0 and parse_rate < 0.95 as stop from c)"""


@query(f"with {CALLS}, {CHECK} select * from i")
def judge_instrument(spark, d):
    return judge.instrument(_calls(spark, d))


@query(f"""with {ARMS.replace("k = 99 as output_cap_hit", "false as output_cap_hit").replace("k < 95", "k < 98")}, {CHECK}
select arm, not void and not stop as evaluated, case when not void and not stop and covered then median_range <= 2 and max_range <= 4 when not void and not stop then false end as opens,
case when void then 'void' when stop then 'stop' when not covered then 'coverage' else 'bounds' end as reason from a cross join i""")
def judge_gate(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    calls = _read(spark, d, "events").select(F.col("event_type").alias("arm"), (F.col("user_id") % 10).alias("task"), F.when(k < 98, k % 11).alias("score"), F.lit(False).alias("output_cap_hit"))
    return judge.gate(judge.instrument(calls), judge.arm_aggregate(judge.spread(calls, 150), 8))


@query("""select event_type as arm, user_id % 10 as task, count(distinct user_id) as payloads from events group by all having count(distinct user_id) > 1""")
def payload_constancy(spark, d):
    return judge.payload_constancy(_read(spark, d, "events").select(F.col("event_type").alias("arm"), (F.col("user_id") % 10).alias("task"), F.col("user_id").alias("digest")))


@query("""with a(arm) as (values ('cold'), ('warm')), t as (select n_nationkey::bigint as task from nation), n as (select unnest(range(3))::int as call),
c as (select 'cold' as arm, s_nationkey::bigint as task, (s_suppkey % 3)::int as call, max(s_suppkey % 11)::int as score from supplier group by all)
select arm, task, call, score from a cross join t cross join n left join c using (arm, task, call)""")
def call_grid(spark, d):
    arms = spark.createDataFrame([("cold",), ("warm",)], "arm string")
    tasks = _read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("task"))
    s = _read(spark, d, "supplier").groupBy(F.lit("cold").alias("arm"), F.col("s_nationkey").cast("long").alias("task"), (F.col("s_suppkey") % 3).cast("int").alias("call"))
    return compare.call_grid(arms, tasks, 3, s.agg(F.max(F.col("s_suppkey") % 11).cast("int").alias("score")))


@query("""select event_id, coalesce(value, 0)::double * 3.0::double / 1000000.0::double + event_id::double * 15.0::double / 1000000.0::double as cost from (select event_id, case when user_id % 3 = 0 then null else value end as value from events)""")
def call_cost(spark, d):
    own = _read(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("value")).alias("a"))
    return own.select("event_id", X.cost(X.first_of("a", F.lit(0.0)), F.col("event_id"), F.lit(3.0), F.lit(15.0)).alias("cost"))


@query("select doc_id, substr(text, 1, 1200) as prompt, coalesce(length(text) > 1200, false) as capped from documents")
def prompt_caps(spark, d):
    cut, fired = X.capped(F.col("text"), 1200)
    return _read(spark, d, "documents").select("doc_id", cut.alias("prompt"), fired.alias("capped"))
