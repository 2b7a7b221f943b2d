"""Text and gate queries over the driver's tables, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritally.functions import expressions as X
from veritally.operators import compare, gates, text
from veritally.plans.hosted import _read, query


@query(r"""with w as (select doc_id, unnest(list_distinct(string_split(lower(regexp_replace(text, '[^\p{L}\p{N}_]', ' ', 'g')), ' '))) as word from documents),
b as (select distinct unnest(string_split(lower(regexp_replace(text, '[^\p{L}\p{N}_]', ' ', 'g')), ' ')) as word from benchmark)
select doc_id, word from w join b using (word) where word <> ''""")
def mention_join(spark, d):
    words = _read(spark, d, "benchmark").select(F.explode(F.split(X.normal(F.col("text")), " ")).alias("word"))
    return text.single_word_mentions(_read(spark, d, "documents"), words, "doc_id")


PATHS = """case doc_id % 6 when 0 then 'src/' || source || '/m' || doc_id || '.py' when 1 then 'Tests/' || source || '.py' when 2 then 'src/test_' || doc_id || '.py'
when 3 then '.tox/' || source || '.py' when 4 then 'docs.py' else 'lib/' || source || '_test.py' end"""


@query(rf"""with p as (select doc_id, {PATHS} as path from documents), x as (select *, string_split(lower(path), '/') as parts from p)
select doc_id, path, path like '%.py' and len(list_filter(parts[:-2], lambda y: y in ('test', 'tests', 'testing', 'doc', 'docs') or starts_with(y, '.'))) = 0
and not starts_with(parts[-1], 'test_') and not ends_with(parts[-1], '_test.py') and parts[-1] <> 'conftest.py' as production from x""")
def production_python(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.expr(PATHS.replace("doc_id ||", "cast(doc_id as string) ||")).alias("path")).withColumn("production", X.production_python(F.col("path")))


SPANS = """s as (select p_brand as path, p_partkey as symbol, (p_partkey % 200)::int as first, (p_partkey % 200 + p_size)::int as last from part),
l as (select p_brand as path, (p_partkey % 250)::int as line from part)"""


def _spans(spark, d):
    part = _read(spark, d, "part")
    spans = part.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("symbol"), (F.col("p_partkey") % 200).cast("int").alias("first"), (F.col("p_partkey") % 200 + F.col("p_size")).cast("int").alias("last"))
    lines = part.select(F.col("p_brand").alias("path"), (F.col("p_partkey") % 250).cast("int").alias("line"))
    return lines, spans


@query(f"with {SPANS} select distinct path, symbol from l join s using (path) where line between first and last")
def scope_range_join(spark, d):
    lines, spans = _spans(spark, d)
    return text.in_spans(lines, spans, ["path"])


@query(f"with {SPANS} select distinct path, symbol from l join s using (path) where not (line + 3 < first or line > last)")
def span_overlap(spark, d):
    lines, spans = _spans(spark, d)
    return text.touching(lines.select("path", F.col("line").alias("a"), (F.col("line") + 3).alias("b")), spans, ["path"])


@query("""with r as (select o_orderkey % 97 as task, o_custkey % 4 = 0 as refused, o_custkey % 3 as old, o_custkey % 3 + (o_orderkey % 5 = 0)::int as new, o_orderkey % 2 = 0 as changed from orders)
select case when refused or old <> new then 'void' when old = new and changed then 'stands' else 'undetermined' end as bucket, count(*) as rows, count(distinct task) as tasks from r group by all""")
def blast_buckets(spark, d):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    own = _read(spark, d, "orders").select((o % 97).alias("task"), (k % 4 == 0).alias("refused"), (k % 3).alias("old"), (k % 3 + (o % 5 == 0).cast("int")).alias("new"), (o % 2 == 0).alias("changed"))
    return gates.blast_buckets(own)


@query("""with r as (select o_custkey % 60 as task, o_orderkey % 4 as f2p_pass, o_orderkey % 3 as p2p_pass, o_orderkey % 5 as n_reported, o_custkey % 60 + 7 as n_graded from orders),
w as (select *, case when n_reported = 0 then 'ran_none' else 'ran_some' end as mechanism from r where f2p_pass = 0 and p2p_pass = 0),
t as (select mechanism, task, max(n_graded) as g from w group by all)
select mechanism, (select count(*) from w where w.mechanism = t.mechanism) as rows, count(*) as tasks, sum(g)::bigint as n_graded from t group by mechanism""")
def all_fail_mechanism(spark, d):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    own = _read(spark, d, "orders").select((k % 60).alias("task"), (o % 4).alias("f2p_pass"), (o % 3).alias("p2p_pass"), (o % 5).alias("n_reported"), (k % 60 + 7).alias("n_graded"))
    return gates.all_fail_mechanism(own)


@query("""select o_orderkey as task, o_custkey % 9 + 1 as n_graded, least(o_orderkey % 10, o_custkey % 9 + 1) as n_failing, o_custkey % 9 + 1 - least(o_orderkey % 10, o_custkey % 9 + 1) as recovered,
case when o_custkey % 9 + 1 <> least(o_orderkey % 10, o_custkey % 9 + 1) then 'measured' when o_custkey % 2 = 0 then 'helper_coupled' else 'recovery_zero_defect' end as outcome from orders""")
def import_recovery(spark, d):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    own = _read(spark, d, "orders").select(o.alias("task"), (k % 9 + 1).alias("n_graded"), F.least(o % 10, k % 9 + 1).alias("n_failing"), F.array(F.lit(True), k % 2 == 0).alias("zero_checks"))
    return gates.recovery(own).drop("zero_checks")


@query("""with t as (select user_id as task, event_id as ordinal, event_type = 'click' as is_control, 'CLEAN' as verdict, (floor(value)::int % 4)::varchar as digest from events),
c as (select task, min_by(digest, ordinal) as control from t where is_control group by all)
select task, ordinal, digest from t join c using (task) where not is_control and digest = control""")
def stale_cache(spark, d):
    digest = (F.floor("value").cast("int") % 4).cast("string").alias("digest")
    own = _read(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("ordinal"), (F.col("event_type") == "click").alias("is_control"), F.lit("CLEAN").alias("verdict"), digest)
    return gates.stale_cache(own)


@query("""with r as (select o_orderkey as task, o_custkey % 3 as a, o_custkey % 4 as b, o_orderkey % 3 as f, o_custkey % 10 = 0 as none from orders)
select task, case when none then null when a > 0 and b > 0 then 'p2p_coupling' when a = 0 and f > 0 then 'f2p_only' else 'p2p_unattributed' end as witness_side from r""")
def witness_enrichment(spark, d):
    k = F.col("o_custkey")
    p2p = F.when(k % 10 != 0, F.when(k % 3 > 0, F.array(F.lit("t"), F.lit("u"))).otherwise(F.array().cast("array<string>")))
    own = _read(spark, d, "orders").select(
        F.col("o_orderkey").alias("task"), F.lit("WITNESS").alias("verdict"), p2p.alias("p2p_failing"), (F.col("o_orderkey") % 3).alias("f2p_fail"),
        F.when(k % 4 > 0, F.array(F.lit("u"))).otherwise(F.array().cast("array<string>")).alias("coupled"),
    )
    return compare.witness_side(own).select("task", "witness_side")


@query("select doc_id, lower(text) like '%429%' or lower(text) like '%toomanyrequests%' or lower(text) like '%too many requests%' as limited from documents")
def rate_limited(spark, d):
    return _read(spark, d, "documents").select("doc_id", X.rate_limited(F.col("text")).alias("limited"))


@query("select c_custkey, 'ns/sweb.eval.x86_64.' || replace(c_name, '#', '_1776_') as image from customer")
def image_refs(spark, d):
    name = F.replace(F.col("c_name"), F.lit("#"), F.lit("__"))
    return _read(spark, d, "customer").select("c_custkey", X.image_ref(name).alias("image"))


@query("""with o as (select o_orderkey, o_orderstatus from orders), a as (select o_orderkey, o_orderstatus from o), b as (select o_orderkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as o_orderstatus from a)
select o_orderkey, o_orderstatus, 'first' as side from (select * from a except all select * from b) union all select o_orderkey, o_orderstatus, 'second' from (select * from b except all select * from a)""")
def differential_check(spark, d):
    a = _read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return compare.agree(a, a.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))))
