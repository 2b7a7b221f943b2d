"""Test logs made of the driver's documents, with a block for each few lines, and what they say of failing tests; each with DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.operators import gates, logs
from veritally.plans.hosted import _read, query

#: The lines that line x of a document, the i-th, becomes in its log, by i mod 6; {11} is i mod 11.
BLOCKS = (
    "____ pkg.test_{11} ____\n{x}\nE  has no attribute 'w{4}'",
    "FAIL: test_{13} (pkg.part{3}.Case)\n{x}\nNameError: name 'w{3}' is not defined",
    "ERROR: test_{17} (pkg.part.Case) (key='{i}')\n{x}\nE  module 'w1' and No module named",
    "======================\n{x}",
    "____ ERROR collecting tests/test_{5}.py ____\n{x}\nE  cannot import name 'w{2}'",
    "ERROR: part{7} (unittest.loader._FailedTest)\n{x}",
)
#: A document's failing tests and the symbol that was renamed in it.
TESTS = ("tests/test_3.py::test_5", "tests/test_9.py::test_40", "pkg/part4/test_z.py::test_41", "test_1 (pkg.part1.Case)", "test_50 (pkg.part5.Other)", "test_8 (pkg.part.Case)", "test_60", "tests/test_1.py::test_61[x]")


def _block(template: str, text, number, line) -> list:
    """The template's parts in order: text(literal), number(modulus, or None for i itself), line."""
    parts = re.split(r"{(\w+)}", template)
    return [text(p) if k % 2 == 0 else line if p == "x" else number(None if p == "i" else int(p)) for k, p in enumerate(parts) if p]


def _sql(template: str) -> str:
    quoted = lambda p: "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return " || ".join(_block(template, quoted, lambda m: f"((k - 1) % {m})" if m else "(k - 1)", "x"))


LOGS = f"""logs as (select doc_id as id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, k: case (k - 1) % 6
  {" ".join(f"when {n} then {_sql(t)}" for n, t in enumerate(BLOCKS))} end), chr(10)) as log from documents where text is not null)"""
SECTIONS = rf"""{LOGS}, cut as (select id, string_split(regexp_replace(log, '\r?\n$', ''), chr(10)) as parts from logs),
l as (select id, regexp_replace(unnest(parts), '\r$', '') as t, generate_subscripts(parts, 1) as n from cut),
m as (select *, case when regexp_matches(t, '^_{{3,}}\s+.+?\s+_{{3,}}$') then trim(regexp_extract(t, '^_{{3,}}\s+(.+?)\s+_{{3,}}$', 1)) end as ruled,
  case when regexp_matches(t, '^(ERROR|FAIL):\s+.+?\s*$') then trim(regexp_extract(t, '^(?:ERROR|FAIL):\s+(.+?)\s*$', 1)) end as named from l),
b as (select *, min(case when ruled is not null then n end) over later as rule, min(case when regexp_matches(t, '^={{10,}}$') then n end) over later as halt, max(n) over (partition by id) + 1 as fin
  from m window later as (partition by id order by n rows between 1 following and unbounded following)),
runs as (select id, ruled as header, 1 as kind, n, coalesce(rule, fin) as last from b where ruled is not null
  union all select id, named, 2, n, coalesce(halt, fin) from b where named is not null),
ranked as (select id, header, kind, n, last, min(n) over (partition by id, header, kind) as place, min(kind) over (partition by id, header) as best,
  row_number() over (partition by id, header, kind order by case when kind = 1 then -n else n end) as r from runs),
sections as (select id, (row_number() over (partition by id order by kind, place))::int as pos, header, n + 1 as first, last from ranked where kind = best and r = 1),
texts as (select s.id, s.pos, s.header, coalesce(string_agg(l.t, chr(10) order by l.n), '') as body from sections s left join l on l.id = s.id and l.n >= s.first and l.n < s.last group by all)"""
ATTRIBUTED = rf"""tests as (select id, unnest([{", ".join(f"'{t}'" for t in TESTS)}]) as test_id, 'w' || id % 4 as symbol from logs),
j as (select t.id, test_id, symbol, pos, header, string_split(test_id, '::')[-1] as tail, string_split(header, '.')[-1] as dotted, trim(string_split(header, ':')[-1]) as colon,
  split_part(test_id, '::', 1) as path, split_part(header, ' ', 1) as module from tests t left join sections s on s.id = t.id),
v as (select *, case when header = tail or dotted = tail or split_part(dotted, '[', 1) = split_part(tail, '[', 1) then 1 when header = test_id then 2
  when contains(header, '.py:') and (colon = tail or split_part(colon, '[', 1) = split_part(tail, '[', 1)) then 3
  when path <> test_id and path <> '' and starts_with(header, 'ERROR collecting') and contains(header, path) then 4
  when contains(header, '_FailedTest') and module <> '' and (list_contains(string_split(regexp_extract(test_id, '\(([^)]*)\)', 1), '.'), module) or list_contains(string_split(path, '/'), module)) then 5 end as level from j),
best as (select id, test_id, symbol, min_by(pos, level * 1000000 + pos) filter (where level is not null) as pos from v group by all)"""


def _logs(spark: SparkSession, d: str) -> DataFrame:
    own = _read(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.explode(F.array(F.split("text", "\n", -1))).alias("x"))

    def block(x: Column, i: Column) -> Column:
        texts = [F.concat(*_block(t, F.lit, lambda m: (i % m if m else i).cast("string"), x)) for t in BLOCKS]
        out = F.when(i % len(BLOCKS) == 0, texts[0])
        for n, t in enumerate(texts[1:], 1):
            out = out.when(i % len(BLOCKS) == n, t)
        return out

    return own.select("id", F.array_join(F.transform("x", block), "\n").alias("log"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return logs.log_lines(_logs(spark, d), "id")


def _tests(spark: SparkSession, d: str) -> DataFrame:
    own = _read(spark, d, "documents").where("text is not null")
    return own.select(F.col("doc_id").alias("id"), F.explode(F.array(*map(F.lit, TESTS))).alias("test_id"), F.concat(F.lit("w"), (F.col("doc_id") % 4).cast("string")).alias("symbol"))


@query(f"with {SECTIONS} select id, pos, header, sha256(body) as body from texts")
def failure_sections(spark, d):
    return logs.failure_sections(_logs(spark, d), "id").select("id", "pos", "header", F.sha2("body", 256).alias("body"))


@query(f"with {SECTIONS} select id, count(*)::bigint as blocks, sum(last - first)::bigint as lines from sections group by id")
def document_sections(spark, d):
    found = logs.sections_of(_lines(spark, d), "id")
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("last") - F.col("first")).cast("long").alias("lines"))


@query(f"with {SECTIONS}, {ATTRIBUTED} select b.id, test_id, b.pos, header from best b left join sections s on s.id = b.id and s.pos = b.pos")
def section_for(spark, d):
    return logs.section_for(logs.sections_of(_lines(spark, d), "id"), _tests(spark, d), "id")


@query(f"""with {SECTIONS}, {ATTRIBUTED}, k as (select b.id, test_id, case when body is null then 'unparsed' when contains(body, 'has no attribute ''' || symbol || '''') or contains(body, 'does not have the attribute ''' || symbol || '''')
or contains(body, 'name ''' || symbol || ''' is not defined') or contains(body, 'cannot import name ''' || symbol || '''') or (contains(body, 'module ''' || symbol || '''') and contains(body, 'No module named')) then 'coupled' else 'broke' end as kind
from best b left join texts t on t.id = b.id and t.pos = b.pos)
select id, coalesce(string_agg(test_id, '|' order by test_id) filter (where kind = 'coupled'), '') as coupled, coalesce(string_agg(test_id, '|' order by test_id) filter (where kind = 'broke'), '') as broke,
coalesce(string_agg(test_id, '|' order by test_id) filter (where kind = 'unparsed'), '') as unparsed, bool_and(kind = 'coupled') as all_reference from k group by id""")
def classify_failures(spark, d):
    lines = _lines(spark, d)
    out = logs.classify_failures(logs.sections_of(lines, "id"), lines, _tests(spark, d), "id")
    return out.select("id", *(F.array_join(c, "|").alias(c) for c in ("coupled", "broke", "unparsed")), "all_reference")


@query(f"""with {SECTIONS}, {ATTRIBUTED}, under as (select b.id, test_id, coalesce(b.pos, s.pos) as pos from best b left join sections s on s.id = b.id and b.pos is null and starts_with(s.header, test_id || ' ('))
select u.id, test_id, count(t.pos)::bigint as blocks, sha256(string_agg(body, chr(10) order by t.pos)) as body from under u left join texts t on t.id = u.id and t.pos = u.pos group by u.id, test_id""")
def subtest_sections(spark, d):
    lines = _lines(spark, d)
    sections = logs.sections_of(lines, "id")
    found = logs.subtest_sections(sections, _tests(spark, d), "id")
    return logs.joined_bodies(found, logs.bodies(sections, lines, "id"), "id").select("id", "test_id", "blocks", F.sha2("body", 256).alias("body"))


#: Of a document's tests, those graded in its run: one, or two where the id leaves 1 or 2 by 3.
GRADED = """graded as (select distinct id, test_id, symbol from (select *, row_number() over (partition by id order by test_id) - 1 as i from tests) where i = id % 8 or (id % 3 > 0 and i = (id + id % 3) % 8)),
under as (select g.id, g.test_id, g.symbol, coalesce(b.pos, s.pos) as pos from graded g join best b using (id, test_id) left join sections s on s.id = g.id and b.pos is null and starts_with(s.header, g.test_id || ' (')),
whole as (select u.id, test_id, symbol, string_agg(body, chr(10) order by t.pos) as body from under u left join texts t on t.id = u.id and t.pos = u.pos group by all),
reach as (select id, test_id, coalesce(contains(body, 'has no attribute ''' || symbol || '''') or contains(body, 'does not have the attribute ''' || symbol || '''') or contains(body, 'name ''' || symbol || ''' is not defined')
  or contains(body, 'cannot import name ''' || symbol || '''') or (contains(body, 'module ''' || symbol || '''') and contains(body, 'No module named')), false) as reaches from whole)"""


@query(f"""with {SECTIONS}, {ATTRIBUTED}, {GRADED}, f as (select id, unnest(range(id % 4)) as k from logs),
r as (select id, bool_and((id + k) % 9 > 0) as round_trip from f group by id), a as (select id, count(*)::bigint as graded, bool_and(reaches) as all_reach from reach group by id)
select l.id, graded, coalesce(round_trip, false) as round_trip, l.id % 5 > 0 as no_residue, l.id % 11 > 0 as ran, all_reach,
  case when coalesce(round_trip, false) and l.id % 5 > 0 and l.id % 11 > 0 and all_reach then 'helper_coupled' else 'recovery_zero_defect' end as outcome
from logs l left join r on r.id = l.id join a on a.id = l.id""")
def zero_recovery(spark, d):
    """Runs in which every graded test fails, and whether that is the task's own coupling: the tests' blocks in the log are asked."""
    lines, every = _lines(spark, d), _tests(spark, d)
    sections, i = logs.sections_of(lines, "id"), F.col("id")
    place = {t: n for n, t in enumerate(sorted(TESTS))}
    at = F.element_at(F.create_map(*(F.lit(x) for pair in place.items() for x in pair)), F.col("test_id"))
    tests = every.where((at == i % 8) | ((i % 3 > 0) & (at == (i + i % 3) % 8)))
    runs = tests.groupBy("id").agg(F.count(F.lit(1)).alias("graded"))
    ids = runs.select("id")
    renamed = ids.where(i % 4 > 0).select("id", F.explode(F.sequence(F.lit(0), (i % 4 - 1).cast("int"))).alias("k")).select("id", ((i + F.col("k")) % 9 > 0).alias("restored"))
    told = gates.zero_checks(runs, renamed, ids.where(i % 5 == 0), ids.where(i % 11 > 0), logs.reached(sections, lines, tests, "id"), "id")
    done = gates.recovery(told.withColumns({"n_graded": F.col("graded"), "n_failing": F.col("graded")}))
    return done.select("id", "graded", *gates.ZERO_CHECKS, "outcome")


STATUSES = """s as (select o_custkey as run, 'test_' || o_orderkey || ' (m.C)' || case when o_orderkey % 3 = 0 then ' ... test_' || (o_orderkey + 1) || ' (m.C) ... test_' || (o_orderkey + 2) || ' (m.C)' else '' end as name,
  case when o_orderkey % 2 = 0 then 'PASSED' else 'FAILED' end as status from orders),
g as (select distinct o_custkey as run, 'test_' || (o_orderkey + unnest([0, 1, 2])) || ' (m.C)' as graded_id from orders),
t as (select o_custkey as run, 'test_' || (o_orderkey + o_orderkey % 2) as name, min(case when o_orderkey % 5 = 0 then 'ERROR' else 'FAILED' end) as told from orders where o_orderkey % 6 = 3 group by all)"""


@query(f"""with {STATUSES} select g.run, graded_id, s.name as merged_key, case when ends_with(s.name, graded_id) then 'last' else 'earlier' end as position,
case when ends_with(s.name, graded_id) then status when g.run in (select run from t) then coalesce(told, 'PASSED') end as true_status
from g join s on s.run = g.run and contains(s.name, ' ... ') and contains(s.name, graded_id) and s.name <> graded_id left join t on t.run = g.run and t.name = split_part(graded_id, ' (', 1)
where not exists (select 1 from s x where x.run = g.run and x.name = graded_id)""")
def swallowed_ids(spark, d):
    k = F.col("o_orderkey")
    name = lambda n: F.concat(F.lit("test_"), n.cast("string"), F.lit(" (m.C)"))
    o = _read(spark, d, "orders").withColumnRenamed("o_custkey", "run")
    merged = F.when(k % 3 == 0, F.concat_ws(" ... ", *(name(k + i) for i in range(3)))).otherwise(name(k))
    statuses = o.select("run", merged.alias("name"), F.when(k % 2 == 0, "PASSED").otherwise("FAILED").alias("status"))
    graded = o.select("run", F.explode(F.array(*(name(k + i) for i in range(3)))).alias("graded_id"))
    line = F.concat(F.when(k % 5 == 0, "ERROR").otherwise("FAIL"), F.lit(": "), name(k + k % 2))
    told = o.where(k % 6 == 3).groupBy("run").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("log"))  # a run's lines
    return logs.swallowed(statuses, graded, "run", logs.log_lines(told, "run"))
