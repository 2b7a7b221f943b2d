"""Diffs and logs made of the driver's documents, so that the text operators run over a whole table; each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.operators import sources, text
from veritally.plans.hosted import _read, query
from veritally.plans.literals import PATHS

TEXTS = rf"""own as (select doc_id, replace(text, chr(13), '') as text, {PATHS} as path from documents)"""


def _own(spark: SparkSession, d: str) -> DataFrame:
    path = F.expr(PATHS.replace("doc_id ||", "cast(doc_id as string) ||"))
    return _read(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("text"), path.alias("path"))


def _patches(spark: SparkSession, d: str) -> DataFrame:
    """A diff for each document: its lines are added to its file, after the line doc_id mod 50, below one that is kept."""
    head = F.format_string("diff --git a/%s b/%s\n--- a/%s\n+++ b/%s\n@@ -%d,1 +%d,2 @@\n kept\n", *["path"] * 4, *[F.col("doc_id") % 50 + 1] * 2)
    added = F.concat(F.lit("+ "), F.replace("text", F.lit("\n"), F.lit("\n+ ")))
    return _own(spark, d).select("doc_id", "path", F.concat(head, added).alias("patch"))


@query(f"""with {TEXTS} select doc_id, path, (doc_id % 50 + 1 + n)::int as line
from (select doc_id, path, generate_subscripts(string_split(text, chr(10)), 1) as n from own)""")
def document_changed_lines(spark, d):
    return text.changed_lines(_patches(spark, d), "doc_id")


@query(rf"""with {TEXTS}, x as (select *, string_split(lower(path), '/') as parts from own),
t as (select doc_id, path, path like '%.py' and len(list_filter(parts[:-2], lambda y: y in ('test', 'tests', 'testing', 'doc', 'docs') or starts_with(y, '.'))) = 0
  and not starts_with(parts[-1], 'test_') and not ends_with(parts[-1], '_test.py') and parts[-1] <> 'conftest.py' as production from x)
select doc_id, path as files, production as eligible, true as single_file, (doc_id % 3)::int as n_fail_to_pass, 1::int as n_pass_to_pass from t""")
def document_eligibility(spark, d):
    some = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    corpus = _patches(spark, d).withColumn("FAIL_TO_PASS", some).withColumn("PASS_TO_PASS", F.array(F.lit("p")))
    out = text.classify(corpus)
    return out.select("doc_id", F.array_join("files_touched", ",").alias("files"), "eligible", "single_file", "n_fail_to_pass", "n_pass_to_pass")


@query(rf"""with {TEXTS}, w as (select o_orderkey as instance_id, o_custkey % 100 as doc_id, case when o_orderkey % 2 = 0 then 'the' else 'scum' end as symbol from orders)
select instance_id, case when regexp_matches(text, '\b' || symbol || '\b') then 'introduced' else 'pre_existing' end as origin from w join own using (doc_id) where text is not null""")
def witness_origins(spark, d):
    witnesses = _read(spark, d, "orders").select(F.col("o_orderkey").alias("instance_id"), (F.col("o_custkey") % 100).alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, "the").otherwise("scum").alias("symbol"))
    patches = _patches(spark, d).where("patch is not null").select("doc_id", F.col("patch").alias("test_patch"))
    return sources.witness_origins(witnesses, patches, "doc_id").select("instance_id", "origin")
