"""Phrases, diffs, labels, answers and gates made of the driver's rows by rule, so that each operator runs over a whole table; each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions import expressions as X
from veritally.operators import gates, sources, text
from veritally.plans.hosted import _read, query


def _text(c: str) -> F.Column:
    return F.col(c).cast("string")


#: What is said of a name n, by doc_id mod 8.
SAID = ("module m has no attribute '{n}'", "<module m> does not have the attribute '{n}'", "name '{n}' is not defined", "cannot import name '{n}' from m", "No module named x: module '{n}'", "module '{n}' is fine", "ValueError: {n}", "")
_SAID = " ".join(f"when {k} then '" + s.replace("'", "''").replace("{n}", "' || said || '") + "'" for k, s in enumerate(SAID))


@query(f"""with n as (select doc_id, text, 'w' || doc_id % 5 as said, 'w' || doc_id % 3 as name from documents), b as (select doc_id, name, text || ' ' || case doc_id % 8 {_SAID} end as body from n)
select doc_id, contains(body, 'has no attribute ''' || name || '''') or contains(body, 'does not have the attribute ''' || name || '''') or contains(body, 'name ''' || name || ''' is not defined')
or contains(body, 'cannot import name ''' || name || '''') or (contains(body, 'module ''' || name || '''') and contains(body, 'No module named')) as names from b""")
def names_symbol(spark, d):
    i = F.col("doc_id")
    said = F.array(*(F.replace(F.lit(s), F.lit("{n}"), F.concat(F.lit("w"), (i % 5).cast("string"))) for s in SAID))
    body = F.concat("text", F.lit(" "), F.get(said, (i % 8).cast("int")))
    return _read(spark, d, "documents").select("doc_id", X.names_symbol(body, F.concat(F.lit("w"), (i % 3).cast("string"))).alias("names"))


#: Two files for each document: one with two hunks, the first of which takes in the document's lines, and a new one.
DIFF = (
    "diff --git a/src/m{i}.py b/src/m{i}.py\n--- a/src/m{i}.py\n+++ b/src/m{i}.py\n@@ -{a},3 +{a},3 @@ def f():\n keep\n-old\n+{t}\n keep\n@@ -900,2 +950,2 @@\n-x\n+y\n z\n"
    "diff --git a/docs/t{i}.txt b/docs/t{i}.txt\nnew file mode 100644\n--- /dev/null\n+++ b/docs/t{i}.txt\n@@ -0,0 +1,1 @@\n+first"
)
_DIFF = "'" + DIFF.replace("\n", "' || chr(10) || '").replace("{i}", "' || doc_id || '").replace("{a}", "' || (doc_id % 50 + 1) || '").replace("{t}", "' || replace(replace(text, chr(13), ''), chr(10), chr(10) || '+') || '") + "'"
DIFFS = f"p as (select doc_id as id, {_DIFF} as patch from documents), l as (select id, unnest(string_split(patch, chr(10))) as t, generate_subscripts(string_split(patch, chr(10)), 1) as n from p)"


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    added = F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\n+"))
    patch = F.lit(DIFF)
    for name, value in (("i", _text("doc_id")), ("a", (F.col("doc_id") % 50 + 1).cast("string")), ("t", added)):
        patch = F.replace(patch, F.lit(f"{{{name}}}"), value)
    return _read(spark, d, "documents").select(F.col("doc_id").alias("id"), patch.alias("patch"))


@query(f"""with {DIFFS}, f as (select id, n, regexp_extract(t, '^diff --git a/(.+?) b/(.+)$', 2) as file from l where t like 'diff --git a/%'), u as (select id, file, min(n) as n from f group by all)
select id, string_agg(file, ',' order by n) as files, count(*)::int as n_files from u group by id""")
def patched_files(spark, d):
    out = _diffs(spark, d).withColumn("f", X.patched_files(F.col("patch"))).where("size(f) > 0")
    return out.select("id", F.array_join("f", ",").alias("files"), F.size("f").alias("n_files"))


@query(f"""with {DIFFS}, f as (select distinct id, regexp_extract(t, '^diff --git a/(.+?) b/(.+)$', 2) as file from l where t like 'diff --git a/%')
select id, count(file)::int as n_files, (count(file) filter (where file like '%.py'))::int as n_targets, count(file) = 1 as single_file, count(file) filter (where file like '%.py') > 0 as eligible from p left join f using (id) group by id""")
def classify_patches(spark, d):
    return text.classify(_diffs(spark, d)).select("id", "n_files", "n_targets", "single_file", "eligible")


@query(rf"""with {DIFFS}, m as (select *, last_value(case when t like 'diff --git a/%' then regexp_extract(t, '^diff --git a/(.+?) b/(.+)$', 2) end ignore nulls) over w as path,
count(case when regexp_matches(t, '^@@ -[0-9]') then 1 end) over w as hunk, last_value(case when regexp_matches(t, '^@@ -[0-9]') then regexp_extract(t, '^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)', 1)::int end ignore nulls) over w as start,
case when regexp_matches(t, '^(\+\+\+|---|diff --git |@@ -[0-9])') then '' else t[1:1] end as sign from l window w as (partition by id order by n)),
c as (select *, coalesce(sum((sign in ('+', ' '))::int) over (partition by id, hunk order by n rows between unbounded preceding and 1 preceding), 0) as before from m)
select distinct id, path, (start + before)::int as line from c where sign in ('+', '-') and start is not null and path is not null""")
def changed_lines(spark, d):
    return text.changed_lines(_diffs(spark, d), "id")


#: A test patch for each document by doc_id mod 4: its symbol comes in, is all of a new file, is on both sides, or is there before.
PATCHES = (
    "diff --git a/t.py b/t.py\n--- a/t.py\n+++ b/t.py\n@@ -1,3 +1,4 @@\n from m import (\n     a,\n+    {s},\n )\n+x = {s}(1)",
    "diff --git a/n.py b/n.py\nnew file mode 100644\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,3 @@\n+def test():\n+    from m import {s}\n+    {s}()",
    "diff --git a/t.py b/t.py\n--- a/t.py\n+++ b/t.py\n@@ -1,2 +1,2 @@\n {s}()\n-{s}(1)\n+{s}(2)",
    "diff --git a/t.py b/t.py\n--- a/t.py\n+++ b/t.py\n@@ -1,2 +1,2 @@\n {s}()\n+other_{s}()",
)


@query("""select doc_id as id, case doc_id % 4 when 0 then 'introduced' when 1 then 'new_file' when 2 then 'mixed' else 'pre_existing' end as origin,
case doc_id % 4 when 0 then 'in_test,module_import' when 1 then 'in_test,local_import' when 2 then 'in_test' else '' end as kinds from documents""")
def patch_origin(spark, d):
    i, name = F.col("doc_id"), F.concat(F.lit("sym"), _text("doc_id"))
    patch = F.get(F.array(*(F.replace(F.lit(p), F.lit("{s}"), name) for p in PATCHES)), (i % 4).cast("int"))
    return sources.patch_origin(_read(spark, d, "documents").select(i.alias("id"), patch.alias("patch"), name.alias("symbol")), "id")


LABEL = "case o_orderkey % 4 when 0 then 'rename:src/a' || o_custkey || '.py:f' when 1 then 'reverse:<no anchor>' when 2 then 'bare' else '<control>' end"


@query(rf"""with l as (select o_orderkey as id, {LABEL} as label, case when o_custkey % 5 > 0 then ' ' || replace(o_orderpriority, '-', '  ' || chr(10)) || ' x' end as reason from orders) select id, split_part(label, ':', 1) as operator,
nullif(case when contains(label, ':') then substr(label, instr(label, ':') + 1) else '' end, '<no anchor>') as anchor, trim(regexp_replace(coalesce(reason, ''), '\s+', ' ', 'g')) as reason from l where label <> '<control>'""")
def log_labels(spark, d):
    k = F.col("o_orderkey") % 4
    label = F.when(k == 0, F.concat(F.lit("rename:src/a"), _text("o_custkey"), F.lit(".py:f"))).when(k == 1, "reverse:<no anchor>").when(k == 2, "bare").otherwise("<control>")
    reason = F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit(" "), F.replace("o_orderpriority", F.lit("-"), F.lit("  \n")), F.lit(" x")))
    own = _read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), label.alias("label"), reason.alias("reason")).where("label <> '<control>'")
    return own.select("id", X.label_operator(F.col("label")).alias("operator"), X.label_anchor(F.col("label")).alias("anchor"), X.same_words(F.col("reason")).alias("reason"))


#: A judge's answers by o_orderkey mod 12, and whether their score n, from 0 to 12, is one that counts.
ANSWERS = (
    ('Text {"score": {n}}', True), ('{"score": true}', False), ('{"score": {n}.0}', False), ('{"detail": {"score": 3}, "score": {n}}', True), ('{"detail": {"score": {n}}}', False), ("none", False),
    ('{"score": ', False), ("", False), ('{"score": "{n}"}', False), ('{"score": -1{n}}', False), ('a {"why": "x } y", "score": {n}} tail', True), ('"score": {n}', False),
)


@query(f"""select o_orderkey as id, case when o_orderkey % 12 in ({", ".join(str(k) for k, (_, counts) in enumerate(ANSWERS) if counts)}) and o_custkey % 13 <= 10 then (o_custkey % 13)::int end as score from orders""")
def judge_answers(spark, d):
    answer = F.get(F.array(*(F.replace(F.lit(a), F.lit("{n}"), (F.col("o_custkey") % 13).cast("string")) for a, _ in ANSWERS)), (F.col("o_orderkey") % 12).cast("int"))
    return _read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), X.judge_score(answer).alias("score"))


@query("""with m as (select case when l_returnflag = 'N' then 'train' else 'held_out' end as bucket, case when l_discount >= 0.09 then 1.0 else 0.0 end as reward from lineitem), e as (select * from m union all select 'pooled', reward from m)
select bucket, count(*) as mutants, count(*) filter (where reward > 0) as survivors, (count(*) filter (where reward > 0))::double / count(*) as survival from e group by bucket""")
def mutation_survival(spark, d):
    own = _read(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") == "N", "train").otherwise("held_out").alias("bucket"), _text("l_orderkey").alias("name"), F.when(F.col("l_discount") >= 0.09, 1.0).otherwise(0.0).alias("reward")
    )
    return gates.mutation_survival(own)


CELLS = """g as (select c_custkey as task, c_custkey % 6 as k, unnest(['original', 'repaired']) as variant from customer), h as (select *, unnest(['gold', 'gold_renamed', 'mut1', 'mut2']) as solution from g),
c as (select task, variant, solution, starts_with(solution, 'mut') as is_mutant,
  case when variant = 'repaired' and solution = 'mut1' and k = 1 then 1.0 when starts_with(solution, 'mut') or (variant = 'original' and solution = 'gold_renamed') or (k = 2 and variant = 'repaired' and solution = 'gold_renamed') then 0.0 else 1.0 end as reward,
  case when variant = 'repaired' and solution = 'mut2' and k = 3 then 3 else 5 end as present, variant = 'repaired' and solution = 'mut1' and k = 4 as names_symbol,
  case when not starts_with(solution, 'mut') then '' when variant = 'repaired' and solution = 'mut2' and k = 5 then 't2' else 't1' end as failing from h)"""


@query(f"""with {CELLS}, s as (select task, solution, max(failing) filter (where variant = 'original') = max(failing) filter (where variant = 'repaired') as held from c where is_mutant group by all),
v as (select task, bool_or(variant = 'repaired' and solution = 'gold_renamed' and reward = 1) as c1,
bool_and(reward = 0) filter (where variant = 'repaired' and is_mutant) and not bool_or(is_mutant and names_symbol) and
  min(present) filter (where variant = 'repaired' and is_mutant) >= max(present) filter (where variant = 'repaired' and solution = 'gold') as c2,
bool_or(variant = 'repaired' and solution = 'gold' and reward = 1) as g1 from c group by task), w as (select task, bool_and(held) as c3 from s group by task)
select task, c1, c2, g1, c3, c1 and c2 and g1 and c3 as passes from v join w using (task)""")
def gate_verdict(spark, d):
    k, v, s = F.col("k"), F.col("variant"), F.col("solution")
    grid = _read(spark, d, "customer").select(F.col("c_custkey").alias("task"), (F.col("c_custkey") % 6).alias("k"), F.explode(F.array(F.lit("original"), F.lit("repaired"))).alias("variant"))
    grid = grid.select("*", F.explode(F.array(*map(F.lit, ("gold", "gold_renamed", "mut1", "mut2")))).alias("solution"))
    mutant, repaired = F.startswith("solution", F.lit("mut")), v == "repaired"
    lost = mutant | ((v == "original") & (s == "gold_renamed")) | ((k == 2) & repaired & (s == "gold_renamed"))
    failing = F.when(~mutant, F.array().cast("array<string>")).when(repaired & (s == "mut2") & (k == 5), F.array(F.lit("t2"))).otherwise(F.array(F.lit("t1")))
    cells = grid.select(
        "task", "variant", "solution", mutant.alias("is_mutant"), F.when(repaired & (s == "mut1") & (k == 1), 1.0).when(lost, 0.0).otherwise(1.0).alias("reward"),
        F.when(repaired & (s == "mut2") & (k == 3), 3).otherwise(5).alias("present"), (repaired & (s == "mut1") & (k == 4)).alias("names_symbol"), failing.alias("failing"),
    )
    return gates.gate_verdict(cells)
