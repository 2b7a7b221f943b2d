"""Source trees made of the driver's documents: anchors and what comes of them, and reach through imports over one tree of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.operators import sources, trees
from veritally.plans.hosted import _read, query
from veritally.tables import cut

#: A file for each document: two definitions, a list returned, and two messages; {i} is its number, {w} a message.
FILE = "# {c}\ndef f_{i}(x):\n    return list(x)\n\n\nclass _C{i}:\n    def m(self):\n        raise ValueError(\"bad {w}\")\n\n    def n(self):\n        raise KeyError(\"gone {i}\")\n"


def _say(template: str, **of) -> F.Column:
    parts = [template]
    for name, value in of.items():
        parts = [y for x in parts for y in ([x] if not isinstance(x, str) else [z for k, s in enumerate(x.split(f"{{{name}}}")) for z in ([value] if k else []) + [s]])]
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _comment() -> F.Column:
    return F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 60), r"[^ -~]", " ")


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A tree of one file for each document, every eleventh in an old dialect; every fourth tree's issue names its function, every sixth quotes a message."""
    docs, i = _read(spark, d, "documents"), F.col("doc_id")
    text = F.when(i % 11 == 0, F.lit("print 'old'\n")).otherwise(_say(FILE, c=_comment(), i=i, w=F.when(i % 5 == 0, F.concat(F.lit("gone "), i.cast("string"))).otherwise(F.concat(F.lit("w"), i.cast("string")))))
    text = F.when((i % 11 != 0) & (i % 7 == 0), F.concat(text, _say("\n\ndef again():\n    raise OSError(\"gone {i}\")\n", i=i))).otherwise(text)
    files = docs.select(i.cast("string").alias("tree"), _say("pkg/m{i}.py", i=i).alias("path"), text.alias("text"))
    issue = F.when(i % 4 == 0, _say("Please look at f_{i} once more", i=i)).when(i % 6 == 3, _say("It says Gone {i} at once", i=i))
    return files, docs.select(i.cast("string").alias("tree"), issue.alias("issue")).where("issue is not null")


RULE = """t as (select doc_id as i, doc_id % 11 = 0 as old, doc_id % 4 = 0 as named, doc_id % 4 <> 0 and doc_id % 6 = 3 as quoted, doc_id % 7 = 0 as again, doc_id % 5 = 0 as five from documents),
a as (select i, null as operator, 'pkg/m' || i || '.py' as label, null as tier, 1 as line from t where old
  union all select i, 'symbol_rename', 'f_' || i, 'MEDIUM', 2 from t where not old
  union all select i, 'symbol_rename', '_C' || i, 'HIGH', 6 from t where not old
  union all select i, 'symbol_rename', 'again', 'MEDIUM', 14 from t where not old and again
  union all select i, 'collection_reverse', 'f_' || i || ':3', 'MEDIUM', 3 from t where not old
  union all select i, 'message_reword', 'bad ' || case when five then 'gone ' || i else 'w' || i end, 'MEDIUM', 8 from t where not old
  union all select i, 'message_reword', 'gone ' || i, 'MEDIUM', 11 from t where not old
  union all select i, 'message_reword', 'gone ' || i, 'MEDIUM', 15 from t where not old and again)"""


@query(f"with {RULE} select i::varchar as tree, operator, label, tier, line::int as line from a")
def operator_anchors(spark, d):
    files, _ = _files(spark, d)
    return trees.anchors(files).select("tree", "operator", "label", "tier", "line")


@query(f"""with {RULE}, o as (select a.*, case when operator is null then 'does not parse'
  when operator = 'symbol_rename' and named and label = 'f_' || a.i then 'the issue names it'
  when operator = 'message_reword' and quoted and label = 'gone ' || a.i then 'the issue quotes it'
  when operator = 'message_reword' and label = 'gone ' || a.i and again then '2 places hold it' end as reason from a join t using (i))
select i::varchar as tree, operator, case when operator is not null then label end as label, line::int as line, case when reason is null then 'APPLIED' else 'REFUSED' end as status, reason from o""")
def operator_applications(spark, d):
    return trees.applications(*_files(spark, d)).select("tree", "operator", "label", "line", "status", "reason")


TEXT = FILE.replace("'", "''").replace("\n", "' || chr(10) || '").replace("{c}", "' || c || '").replace("{i}", "' || i || '").replace("{w}", "' || w || '")
FILES = f"""d as (select doc_id as i, regexp_replace(substr(coalesce(text, ''), 1, 60), '[^ -~]', ' ', 'g') as c, case when doc_id % 5 = 0 then 'gone ' || doc_id else 'w' || doc_id end as w from documents),
files as (select i, case when i % 11 = 0 then 'print ''old''' || chr(10) else '{TEXT}' || case when i % 7 = 0 then chr(10) || chr(10) || 'def again():' || chr(10) || '    raise OSError("gone ' || i || '")' || chr(10) else '' end end as text from d)"""


@query(f"with {RULE} select i::varchar as tree, 'pkg/m' || i || '.py' as path, label as name, tier from a where operator = 'symbol_rename'")
def rename_anchors(spark, d):
    return sources.rename_anchors(sources.occurrences(_files(spark, d)[0]))


@query(rf"""with {RULE}, {FILES} select i::varchar as tree, label as name, case when named and label = 'f_' || i then 'REFUSED' else 'APPLIED' end as status, case when named and label = 'f_' || i then 'the issue names it' end as reason,
case when not (named and label = 'f_' || i) then sha256(regexp_replace(text, '\b' || label || '\b', label || '__renamed', 'g')) end as text from a join t using (i) join files using (i) where operator = 'symbol_rename'""")
def symbol_rename(spark, d):
    files, issues = _files(spark, d)
    places = cut(sources.occurrences(files))  # several joins ask them, files are parsed once
    return sources.rename(files, places, sources.rename_anchors(places), issues).select("tree", "name", "status", "reason", F.sha2("text", 256).alias("text"))


@query(f"""with {RULE}, {FILES}, r as (select distinct i, label, quoted and label = 'gone ' || i or again and label = 'gone ' || i as refused from a join t using (i) where operator = 'message_reword')
select i::varchar as tree, label as message, case when refused then 'REFUSED' else 'APPLIED' end as status, case when not refused then sha256(replace(text, '"' || label || '"', '"[reworded] ' || label || '"')) end as text from r join files using (i)""")
def message_reword(spark, d):
    return sources.reword_messages(*_files(spark, d)).select("tree", "message", "status", F.sha2("text", 256).alias("text"))


@query(f"with {FILES} select i::varchar as tree, 3::int as line, sha256(replace(text, 'return list(x)', 'return list(reversed(list(x)))')) as text from files where i % 11 <> 0")
def collection_reverse(spark, d):
    return sources.reverse_returns(_files(spark, d)[0]).select("tree", "line", F.sha2("text", 256).alias("text"))


#: Module i of one tree of all documents, by i mod 10, with what it imports of modules before it.
MODULES = (
    "def f_{0}(x):\n    return x\n\n\ndef _g_{0}(x):\n    return x\n",
    "from pkg.m{1} import f_{1} as g_{0}\n",
    "from pkg.m{1} import *\n",
    "from .m{1} import g_{2}\n",
    "from pkg import m{1}\n\nown = m{1}.g_{3}(1)\n",
    "import pkg.m{2} as q\n\nown = q.g_{4}(2)\n",
    "from pkg.m{6} import f_{6}, _g_{6}\n\nown = f_{6}(_g_{6}(3))\n",
    "from pkg.m{1} import *\n",
    "from pkg.m{1} import *\nfrom pkg.m{5} import *\n\nown = f_{8}(g_{7})\n",
    "from .m{1} import *\n\n__all__ = ['f_{9}']\n",
)
IMPORTS = """e as (select doc_id as i, doc_id % 10 as r from documents),
named as (select i as place, i - 1 as source, 'f_' || (i - 1) as name, 'g_' || i as alias from e where r = 1 union all select i, i - 1, 'g_' || (i - 2), 'g_' || (i - 2) from e where r = 3
  union all select i, i - 6, 'f_' || (i - 6), 'f_' || (i - 6) from e where r = 6 union all select i, i - 6, '_g_' || (i - 6), '_g_' || (i - 6) from e where r = 6),
stars as (select i as place, i - 1 as source from e where r in (2, 7, 8, 9) union all select i, i - 5 from e where r = 8),
defs as (select i as module, 'f_' || i as name from e where r = 0 union all select i, '_g_' || i from e where r = 0)"""
REACH = f"""{IMPORTS}, reached as (select module, name, module as place, name as alias, 0 as hops from defs union
  select x.module, x.name, y.place, y.alias, x.hops + 1 from reached x join (select place, source, name, alias, false as star from named union all select place, source, null, null, true from stars) z on z.source = x.place and (z.star or z.name = x.alias),
  lateral (select z.place as place, case when z.star then x.alias else z.alias end as alias) y where not (z.star and starts_with(x.alias, '_'))),
reach as (select module, name, place, alias, min(hops) as hops from reached group by all)"""


def _modules(spark: SparkSession, d: str) -> DataFrame:
    docs, i = _read(spark, d, "documents"), F.col("doc_id")
    text = F.when(i % 10 == 0, _say(MODULES[0], **{"0": i}))
    for r, m in enumerate(MODULES[1:], 1):
        text = text.when(i % 10 == r, _say(m, **{str(k): i - k for k in range(10)}))
    return docs.select(F.lit("all").alias("tree"), _say("pkg/m{0}.py", **{"0": i}).alias("path"), F.concat(F.lit("# "), _comment(), F.lit("\n"), text).alias("text"))


@query(f"with recursive {REACH} select 'pkg.m' || module as module, name, 'pkg.m' || place as \"at\", alias, hops::int as hops from reach")
def symbol_reach(spark, d):
    return trees.reach(trees.import_edges(_modules(spark, d))).select("module", "name", "at", "alias", "hops")


@query(f"""with recursive {REACH}, uses as (select place, alias, 'name' as how from reach where hops = 0 union all select place, name, 'name' from named where place % 10 in (3, 6)
  union all select i, unnest(['f_' || (i - 6), '_g_' || (i - 6)]), 'name' from e where r = 6 union all select i, unnest(['f_' || (i - 8), 'g_' || (i - 7)]), 'name' from e where r = 8
  union all select i - 1, 'g_' || (i - 3), 'attribute' from e where r = 4 union all select i - 2, 'g_' || (i - 4), 'attribute' from e where r = 5)
select 'pkg.m' || module as module, name, how, count(*)::bigint as n from uses join reach using (place, alias) group by all""")
def symbol_references(spark, d):
    files = _modules(spark, d)
    edges = trees.import_edges(files)
    return trees.references(sources.occurrences(files), edges, trees.reach(edges)).groupBy("module", "name", "how").agg(F.count(F.lit(1)).alias("n"))
