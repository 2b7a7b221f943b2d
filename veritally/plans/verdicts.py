"""Scopes, oracles, grids and totals as queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritally.functions import expressions as X
from veritally.operators import logs, text, verdicts
from veritally.plans.hosted import ROWS, _read, _rows, query


@query("""with a as (select l_orderkey as instance_id, l_partkey as anchor, case when l_linenumber % 2 = 0 then 'f' || l_suppkey % 20 end as func, 'f' || l_suppkey % 7 as name from lineitem),
s as (select o_orderkey as instance_id, 'f' || o_custkey % 20 as symbol from orders where o_orderstatus <> 'P')
select a.instance_id, anchor, func, name from a where exists (select 1 from s where s.instance_id = a.instance_id and s.symbol = coalesce(func, name))
or a.instance_id in (select o_orderkey from orders where o_orderpriority = '1-URGENT')""")
def anchors_in_scope(spark, d):
    f = lambda n: F.concat(F.lit("f"), n.cast("string"))
    anchors = _read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("instance_id"), F.col("l_partkey").alias("anchor"), F.when(F.col("l_linenumber") % 2 == 0, f(F.col("l_suppkey") % 20)).alias("func"), f(F.col("l_suppkey") % 7).alias("name")
    )
    orders = _read(spark, d, "orders").withColumnRenamed("o_orderkey", "instance_id")
    scope = orders.where("o_orderstatus <> 'P'").select("instance_id", f(F.col("o_custkey") % 20).alias("symbol"))
    return verdicts.in_scope(anchors, scope, unscoped=orders.where("o_orderpriority = '1-URGENT'"))


@query(f"""with {ROWS}, p as (select instance_id, operator, bool_or(verdict <> 'NOT_APPLICABLE') as a from rs group by all)
select instance_id, coalesce(string_agg(operator, ',' order by operator) filter (where a), '') as with_anchors, coalesce(string_agg(operator, ',' order by operator) filter (where not a), '') as not_applicable
from p group by instance_id""")
def operators_by_anchor(spark, d):
    out = verdicts.operators_by_anchor(_rows(spark, d))
    return out.select("instance_id", F.array_join("operators_with_anchors", ",").alias("with_anchors"), F.array_join("operators_not_applicable", ",").alias("not_applicable"))


@query("select o_orderkey as instance_id, o_orderstatus <> 'P' and o_custkey % 4 <> 0 as mountable from orders")
def mountable_tasks(spark, d):
    error = F.when(F.col("o_custkey") % 4 == 0, F.lit("TimeoutError")).alias("error_type")
    recs = _read(spark, d, "orders").select(F.col("o_orderkey").alias("instance_id"), F.when(F.col("o_orderstatus") != "P", F.struct(error)).alias("row"))
    return recs.select("instance_id", verdicts.mountable().alias("mountable"))


@query("""with r as (select l_orderkey as task, l_linenumber as n, l_partkey, l_returnflag as operator, l_returnflag <> 'N' as loud, l_discount >= 0.05 as broke, l_tax = 0 as unparsed from lineitem)
select task, n, l_partkey, case when loud and not unparsed then not broke end as holds from r""")
def suite_oracle(spark, d):
    ids = lambda on: F.when(on, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>"))
    line = _read(spark, d, "lineitem")
    holds = verdicts.suite_holds(F.col("l_returnflag") != "N", ids(F.col("l_discount") >= 0.05), ids(F.col("l_tax") == 0))
    return line.select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("n"), "l_partkey", holds.alias("holds"))


@query("""with m as (select source, lang, string_agg(distinct doc_id % 5, ',') as printed, list_sort(list(distinct doc_id % 5)) as got, count(*) as n from documents group by all)
select source, lang, got = [0, 1, 2, 3, 4] as holds from m""")
def marker_oracle(spark, d):
    seen = F.array_join(F.sort_array(F.collect_set((F.col("doc_id") % 5).cast("string"))), ",")  # five markers at most
    printed = F.concat(F.lit(" "), seen, F.lit(","), seen, F.lit(",\n")).alias("printed")  # with repetitions
    marks = _read(spark, d, "documents").select("source", "lang", "doc_id").groupBy("source", "lang").agg(printed)
    return marks.select("source", "lang", verdicts.markers_hold(F.trim(F.translate("printed", "\n", " ")), F.array(*(F.lit(str(i)) for i in (4, 3, 2, 1, 0)))).alias("holds"))


@query("""with o as (select *, o_custkey % 6 as c, o_orderkey % 4 as f from orders)
select o_orderkey as task, case when o_orderstatus = 'P' then 'REFUSED' when c = 0 then 'INVALID' when c = 1 then 'UNVALIDATED' when f = 0 then 'CLEAN' when c = 2 then 'BROKEN_OTHER' when f = 1 then 'BROKEN_OTHER'
else 'WITNESS' end as verdict from o""")
def phase_two_verdicts(spark, d):
    c, f = F.col("o_custkey") % 6, F.col("o_orderkey") % 4
    names = lambda *x: F.array(*map(F.lit, x))
    case = _read(spark, d, "orders").select(
        F.col("o_orderkey").alias("task"), F.when(F.col("o_orderstatus") == "P", "REFUSED").otherwise("RAN").alias("outcome"), F.when(c == 0, names("foo")).otherwise(names("bar", "foo", "bar")).alias("markers"),
        (c != 1).alias("observed"), F.when(f == 0, 1.0).otherwise(0.0).alias("reward"), F.when(c == 2, 1).otherwise(0).alias("p2p_fail"), F.when(f == 1, names("a")).otherwise(names("b", "a")).alias("f2p_failing"),
    )
    return case.select("task", verdicts.phase_two(names("foo", "bar"), names("a", "b")).alias("verdict"))


@query("""select o_orderkey as call, sha256('{"arm": ' || to_json(o_orderpriority) || ', "body": {"status": ' || to_json(o_orderstatus) || ', "task": ' || o_custkey || '}, "ids": [' || o_orderkey || ', ' || o_custkey || ']}') as digest from orders""")
def request_digests(spark, d):
    body = {"task": F.col("o_custkey"), "status": F.col("o_orderstatus")}
    payload = {"ids": [F.col("o_orderkey"), F.col("o_custkey")], "body": body, "arm": F.col("o_orderpriority")}
    return _read(spark, d, "orders").select(F.col("o_orderkey").alias("call"), X.payload_digest(payload).alias("digest"))


@query("""with v as (select distinct o_orderpriority as task, o_orderstatus as variant from orders), s as (select distinct l_returnflag as solution from lineitem),
c as (select o_orderpriority as task, o_orderstatus as variant, l_returnflag as solution, min(l_discount) as reward from orders join lineitem on l_orderkey = o_orderkey where o_totalprice < 2000 group by all)
select task, variant, solution, reward from v cross join s left join c using (task, variant, solution)""")
def gate_grid(spark, d):
    o = _read(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey").withColumnsRenamed({"o_orderpriority": "task", "o_orderstatus": "variant"})
    line = _read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "solution")
    variants = o.select("task", "variant").distinct()
    solutions = variants.select("task").distinct().crossJoin(line.select("solution").distinct())  # a few names of each
    cells = o.where("o_totalprice < 2000").join(line, "l_orderkey").groupBy("task", "variant", "solution").agg(F.min("l_discount").alias("reward"))
    return verdicts.gate_grid(variants, solutions, cells)


@query("""with s as (select o_custkey as run, 'test_' || o_orderkey || case when o_orderkey % 3 = 0 then ' ... test_' || (o_orderkey + 1) else '' end as name, case when o_orderkey % 2 = 0 then 'PASSED' else 'FAILED' end as status from orders),
g as (select o_custkey as run, 'test_' || (o_orderkey + o_orderkey % 2) as graded_id from orders union select o_custkey, 'test_' || (o_orderkey + 1) from orders),
a as (select * from g where not exists (select 1 from s where s.run = g.run and s.name = g.graded_id)),
l as (select a.run, graded_id, bool_or(ends_with(name, graded_id) and status = 'PASSED') as passed from a join s on s.run = a.run and contains(name, ' ... ') and contains(name, graded_id) and name <> graded_id group by all),
p as (select run, (select count(*) from a where a.run = g.run) as absent, (select count(*) from l where l.run = g.run) as lost, (select count(*) from l where l.run = g.run and passed) as wrong from (select distinct run from g) g)
select count(*) as logs, count(*) filter (where absent > 0) as logs_with_absent, sum(absent)::bigint as absent_ids, count(*) filter (where lost > 0) as logs_with_swallowed, sum(lost)::bigint as swallowed_ids,
sum(wrong)::bigint as false_failures from p""")
def swallow_totals(spark, d):
    k, name = F.col("o_orderkey"), lambda n: F.concat(F.lit("test_"), n.cast("string"))
    o = _read(spark, d, "orders").withColumnRenamed("o_custkey", "run")
    merged = F.when(k % 3 == 0, F.concat(name(k), F.lit(" ... "), name(k + 1))).otherwise(name(k))
    statuses = o.select("run", merged.alias("name"), F.when(k % 2 == 0, "PASSED").otherwise("FAILED").alias("status"))
    graded = o.select("run", name(k + k % 2).alias("graded_id")).union(o.select("run", name(k + 1))).distinct()
    return logs.swallow_totals(statuses, graded, "run")


THREES = r"""select distinct {key}unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as phrase
from (select {key}string_split(lower(regexp_replace(text, '[^\p{{L}}\p{{N}}_]', ' ', 'g')), ' ') as w from {table})"""


@query(f"""with g as ({THREES.format(key="doc_id, ", table="documents")}), p as ({THREES.format(key="", table="benchmark")})
select doc_id, phrase from g join p using (phrase) where regexp_matches(phrase, '^[^ ]+ [^ ]+ [^ ]+$')""")
def phrase_mentions(spark, d):
    """Documents that hold three words as they stand in a benchmark item, for all such of every item."""
    words = _read(spark, d, "benchmark").select(F.split(X.normal(F.col("text")), " ").alias("w")).where("size(w) >= 3")
    threes = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))
    phrases = words.select(F.explode(threes).alias("phrase")).where(F.col("phrase").rlike("^[^ ]+ [^ ]+ [^ ]+$")).distinct()
    return text.phrase_mentions(_read(spark, d, "documents"), phrases, "doc_id", [3])


@query("""with t as (select o_custkey as overlay, o_orderkey % 50 as path, o_orderstatus = 'P' as production from orders), f as (select c_custkey as overlay, unnest(range(25)) as path from customer)
select overlay, 'outside' as problem, path::varchar as path from t where not exists (select 1 from f where f.overlay = t.overlay and f.path = t.path)
union all select overlay, 'production', path::varchar from t where production
union all select c_custkey, 'empty', null from customer where c_custkey not in (select overlay from t)""")
def overlay_problems(spark, d):
    touched = _read(spark, d, "orders").select(F.col("o_custkey").alias("overlay"), (F.col("o_orderkey") % 50).cast("string").alias("path"), (F.col("o_orderstatus") == "P").alias("production"))
    files = _read(spark, d, "customer").select(F.col("c_custkey").alias("overlay"), F.explode(F.array(*(F.lit(str(i)) for i in range(25)))).alias("path"))
    return verdicts.overlay_problems(touched, files)


@query("""select o_orderkey as task, sha256(o_orderpriority) as digest, length(o_orderpriority)::int as graded from orders""")
def graded_once(spark, d):
    rows = _read(spark, d, "orders").select(F.col("o_orderkey").alias("task"), F.sha2("o_orderpriority", 256).alias("digest"), "o_orderpriority")
    return verdicts.graded_once(rows, lambda once: once.select("digest", F.length("o_orderpriority").alias("graded"))).select("task", "digest", "graded")
