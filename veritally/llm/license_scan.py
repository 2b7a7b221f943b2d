"""License scans by diagonal voting over word k-grams, in DataFrame operations only."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritally.llm.common import hold
from veritally.llm.license_texts import TEXTS

K = 3
SLACK = 3
LEAST_COVERED = 0.5

#: Phrases that give their label wherever their words stand consecutively.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Bodies, notices and sentences of licenses as lower-case words, with the label that each gives.
TEMPLATES = tuple((label, " ".join(re.findall("[0-9a-z]+", text.lower()))) for label, text in TEXTS)

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: Column) -> Column:
    """The text with A-Z in lower case; a null text is empty.

    Letters beyond ASCII are folded as well, which makes no difference to words of ASCII letters: none of them becomes one, but for the
    Kelvin sign, which is set aside first.
    """
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))


def words(text: str = "text") -> Column:
    """Words with A-Z in lower case: runs of digits, letters and anything beyond ASCII. Null and empty texts have none."""
    return F.filter(F.split(_lower(F.col(text)), _SPLIT, -1), lambda w: w != "")


def _apart(docs: DataFrame) -> DataFrame:
    """(ka, kb, w): each row's key and words; the one-row explode keeps the split from being copied into its uses."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("ka"), F.xxhash64(F.lit(7), "text", "doc_id").alias("kb"), F.array(words()).alias("x"))
    return rows.select("ka", "kb", F.explode("x").alias("w"))


def template_grams(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES, k: int = K) -> DataFrame:
    """(hash, gram, label, template, place): every k-gram of every template; as long as the list of templates."""
    rows = []
    for t, (label, text) in enumerate(templates):
        w = text.split()
        rows += [(" ".join(w[i : i + k]), label, t, i, len(w) - k + 1) for i in range(len(w) - k + 1)]
    df = spark.createDataFrame(rows, "gram string, label string, template int, place int, n_grams int")
    return df.withColumn("hash", F.xxhash64("gram"))


def license_spans(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, k: int = K, slack: int = SLACK, least: float = LEAST_COVERED) -> DataFrame:
    """(ka, kb, label, template, first_word, last_word, covered): verified spans of templates in documents.

    All rolling word k-grams of all documents are joined by hash to the template positions, and by the words
    themselves, so that equal hashes of different words never count. Hits vote for their diagonal (place in the text
    minus place in the template); diagonals at most ``slack`` apart are merged, which bridges inserted and lost words;
    a merged span stands if it covers at least ``least`` of the template's k-grams. The templates are a fixed list, so
    that side is broadcast.
    """
    grams = F.transform(
        F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat_ws(" ", *(F.get("w", i + j) for j in range(k))),
    )
    rolled = _apart(docs).select("ka", "kb", F.posexplode(grams).alias("at", "gram")).withColumn("hash", F.xxhash64("gram"))
    known = template_grams(docs.sparkSession, templates, k)
    hits = rolled.join(F.broadcast(known), ["hash", "gram"]).select("ka", "kb", "label", "template", "n_grams", "place", "at").distinct()
    votes = hits.groupBy("ka", "kb", "label", "template", "n_grams", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.min("at").alias("a"), F.max("at").alias("b"), F.collect_set("place").alias("places")
    )  # places: no more than the template has
    by = Window.partitionBy("ka", "kb", "template").orderBy("diagonal")
    far = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > slack).cast("int"), F.lit(1))
    merged = votes.withColumn("far", far).withColumn("span", F.sum("far").over(by))
    spans = merged.groupBy("ka", "kb", "label", "template", "n_grams", "span").agg(
        F.min("a").alias("first_word"), (F.max("b") + k - 1).alias("last_word"), F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("n")
    )
    spans = spans.withColumn("covered", F.col("n") / F.col("n_grams")).where(F.col("covered") >= least)
    return spans.select("ka", "kb", "label", "template", "first_word", "last_word", "covered")


def base_places(w: Column, text: Column) -> Column:
    """Array of (first word, label) of all base phrases, looked for only where the text has their longest word."""
    low = _lower(text)
    out = []
    for phrase, label in BASE_PHRASES.items():
        parts = phrase.split()
        places = F.filter(F.transform(w, _starts(w, parts, label)), lambda x: x.isNotNull())
        there = _all_in(low, parts)
        out.append(F.when(there, places).otherwise(F.array().cast("array<struct<at:int,label:string>>")))
    return F.concat(*out)


def _starts(w: Column, parts: list[str], label: str) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.when(_all(w, i, parts), F.struct(i.alias("at"), F.lit(label).alias("label")))


def _all(w: Column, i: Column, parts: list[str]) -> Column:
    out = F.get(w, i) == parts[0]
    for j, p in enumerate(parts[1:], 1):
        out = out & (F.get(w, i + j) == p)
    return out


def _all_in(low: Column, parts: list[str]) -> Column:
    out = F.contains(low, F.lit(parts[0]))
    for p in parts[1:]:
        out = out & F.contains(low, F.lit(p))
    return F.coalesce(out, F.lit(False))


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    base_labels come from the fixed phrases, labels adds those of verified template spans; both are distinct, sorted
    and joined by commas, empty without any. score is 1 with a base phrase, else the largest covered share of a span,
    else 0. Null and empty texts have no words and no labels. Repeated rows come back alike; a null doc_id is kept.
    Other columns are ignored.
    """
    spans = license_spans(docs, templates).groupBy("ka", "kb").agg(F.collect_set("label").alias("found"), F.max("covered").alias("best"))
    spans = hold(spans, "spans")  # a table, so that the join can split the copies of one row
    rows = docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("ka"), F.xxhash64(F.lit(7), "text", "doc_id").alias("kb"), "text", F.array(words()).alias("x")
    )
    rows = rows.select("doc_id", "ka", "kb", "text", F.explode("x").alias("w"))
    rows = rows.select("doc_id", "ka", "kb", F.size("w").cast("long").alias("n_words"), F.array(base_places(F.col("w"), F.col("text"))).alias("x"))
    rows = rows.select("doc_id", "ka", "kb", "n_words", F.explode("x").alias("base"))
    rows = rows.join(spans, ["ka", "kb"], "left")
    base, none = F.col("base.label"), F.array().cast("array<string>")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.at").cast("long").alias("first_word"),
        F.array_max("base.at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    grams = ", ".join(
        f"('{' '.join(w[i : i + K])}', '{label}', {t}, {i}, {len(w) - K + 1})"
        for t, (label, text) in enumerate(TEMPLATES)
        for w in [text.split()]
        for i in range(len(w) - K + 1)
    )
    phrases = ", ".join(f"('{p}', '{n}', {len(p.split())})" for p, n in BASE_PHRASES.items())
    split = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
with docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{split}') as w from documents),
places as (select doc_id, unnest(w) as x, unnest(range(len(w))) as pos from docs),
chain as (
  select doc_id, pos, x, lead(x) over p as y, lead(x, 2) over p as z from places window p as (partition by doc_id order by pos)
),
phrases(phrase, label, n) as (values {phrases}),
base as (
  select doc_id, pos, label from chain join phrases on phrase = case when n = 2 then x || ' ' || y else x || ' ' || y || ' ' || z end
),
grams(gram, label, template, place, n_grams) as (values {grams}),
hits as (select doc_id, label, template, n_grams, place, pos from chain join grams on gram = x || ' ' || y || ' ' || z),
diagonals as (select distinct doc_id, template, pos - place as diagonal from hits),
far as (
  select *, case when diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) <= {SLACK} then 0 else 1 end as far from diagonals
),
spans as (select *, sum(far) over (partition by doc_id, template order by diagonal) as span from far),
covered as (
  select doc_id, label, count(distinct place)::double / n_grams as covered
  from hits join spans using (doc_id, template) where hits.pos - hits.place = spans.diagonal group by doc_id, label, template, n_grams, span
),
found as (select * from covered where covered >= {LEAST_COVERED}),
every as (select doc_id, label from base union select doc_id, label from found)
select doc_id, len(w)::bigint as n_words,
  (select count(*) from base b where b.doc_id = d.doc_id)::bigint as n_base,
  (select min(pos) from base b where b.doc_id = d.doc_id)::bigint as first_word,
  (select max(pos) from base b where b.doc_id = d.doc_id)::bigint as last_word,
  coalesce((select string_agg(distinct label, ',' order by label) from base b where b.doc_id = d.doc_id), '') as base_labels,
  coalesce((select string_agg(label, ',' order by label) from every e where e.doc_id = d.doc_id), '') as labels,
  case when exists (select 1 from base b where b.doc_id = d.doc_id) then 1.0::double
    else coalesce((select max(covered) from found f where f.doc_id = d.doc_id), 0.0::double) end as score
from docs d
"""


ORACLE_SQL = _oracle()
