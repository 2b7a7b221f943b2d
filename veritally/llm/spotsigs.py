"""Document fingerprints by SpotSigs: chains of content words that follow common words, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritally.llm.common import hold

CHAIN = 2
DIGITS = 8
#: Common words of English, German, Spanish and French, the anchors.
ANCHORS = tuple(
    sorted(
        set(
            """the of and to a in is that it for was on with be by as this are at from
            der die und in den von zu das mit sich auf des für ist nicht dem im ein als eine
            de la que el en y los se del las por un no con su una es para al lo
            le et les des du une pour est qui par dans sur au pas avec ou""".split()
        )
    )
)


def _once(rows: DataFrame, keep: list[str], column: Column, name: str) -> DataFrame:
    """rows with one more column, by a one-row explode, so that later columns read its value rather than compute it anew."""
    return rows.select(*keep, F.explode(F.array(column)).alias(name))


def with_signatures(rows: DataFrame, text: str, name: str, chain: int = CHAIN, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """rows with the text's set of signatures in column ``name``: sorted strings of DIGITS hex digits.

    Words are runs of letters (of characters beyond ASCII too) in lower case; those that are no anchor are content words. Every anchor followed by a content
    word gives the signature of itself and the next ``chain`` content words (fewer at the text's end). A text that comes to none is its own one signature; an
    empty text has an empty set. Each step is linear in the text: an anchor at word i, with j anchors before it, is followed by content word i - j.
    """
    own = list(rows.columns)
    words = F.filter(F.split(F.lower(F.col(text)), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", -1), lambda x: x != "")
    out = _once(rows, own, words, "_w")
    places = F.filter(F.transform("_w", lambda x, i: F.when(x.isin(*anchors), i)), lambda i: i.isNotNull())
    out = _once(out, [*own, "_w"], F.struct(places.alias("at"), F.filter("_w", lambda x: ~x.isin(*anchors)).alias("c")), "_x")

    def signature(i: Column, j: Column) -> Column:
        parts = F.concat_ws(" ", F.get("_w", i), *(F.get("_x.c", i - j + k) for k in range(chain)))
        return F.when(F.get("_x.c", i - j).isNotNull(), F.substring(F.md5(parts), 1, DIGITS))

    out = _once(out, own, F.filter(F.transform("_x.at", signature), lambda s: s.isNotNull()), "_s")
    alone = F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.array(F.substring(F.md5(F.concat(F.lit("="), F.col(text))), 1, DIGITS)))
    return _once(out, own, F.when(F.size("_s") == 0, alone).otherwise(F.array_sort(F.array_distinct("_s"))), name)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets; two empty ones are alike. Pairs whose lengths alone keep them under ``least`` are 0 and not compared."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    same = F.size(F.array_intersect(a, b))
    exact = F.when(large == 0, 1.0).otherwise(same / (small + large - same).cast("double"))
    return exact if least <= 0 else F.when(small < least * large, 0.0).otherwise(exact)


def packed(signatures: Column) -> Column:
    """A set of signatures as bytes, for its way through a shuffle."""
    return F.unhex(F.array_join(signatures, ""))


def unpacked(raw: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.hex(raw)), F.lit(f".{{{DIGITS}}}"), F.lit(0))


def neighbours(ids: DataFrame, key: str = "k", by: str = "doc_id") -> DataFrame:
    """(k, next): the key of the next row by descending ``by``, nulls last; after the last row comes the first. Keys are different.

    Rows are put in order by range; a window runs within one range, and only the first row of each range meets the range before it.
    """
    order = F.col(by).desc_nulls_last()
    spread = hold(ids.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "order")
    inner = spread.select(key, "part", F.lead(key).over(Window.partitionBy("part").orderBy(order)).alias("next"))
    firsts = spread.groupBy("part").agg(F.max_by(key, F.struct(F.col(by).isNotNull(), F.col(by))).alias("first"))
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row for each range
    lead = F.coalesce(F.lead("first").over(Window.orderBy("part")), F.first("first").over(parts))
    return inner.join(F.broadcast(firsts.select("part", lead.alias("after"))), "part").select(key, F.coalesce("next", "after").alias("next"))


def fingerprints(docs: DataFrame, chain: int = CHAIN, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """(doc_id, text, signatures): the set of signatures of every document's whole text; null texts are empty."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return with_signatures(rows, "text", "signatures", chain, anchors)


def edited_likeness(docs: DataFrame, chain: int = CHAIN, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """(doc_id, n_chars, edited, signatures, edited_signatures, near_edited, near_next) of every document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next document by descending id; after the
    last comes the first, so a document alone is its own next. Rows that share an id have one next document, the one of the next id, and of several
    texts under that id the smallest. A null id is last. Null texts are empty. Repeated rows come back alike and as often; other columns are ignored.

    Texts are dealt out by id once; the half that is borrowed goes with the lender's signatures to the borrower, which is there already.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ids = rows.groupBy("k", "doc_id").agg(F.max(F.floor(F.length("text") / 2)).cast("int").alias("half"))
    ids = hold(ids, "ids")
    links = neighbours(ids.select("k", "doc_id")).join(ids.select("k", "half"), "k")
    dealt = rows.select("k", "doc_id", "text").repartition("k")
    lent = dealt.groupBy("k").agg(F.min(F.struct("text", "doc_id")).alias("x")).select("k", "x.text")
    lent = lent.join(links.select(F.col("next").alias("k"), F.col("k").alias("to"), "half"), "k").select("to", "half", "text")
    lent = with_signatures(lent, "text", "s", chain, anchors).select(F.col("to").alias("k"), F.substr("text", F.lit(1), F.col("half")).alias("head"), packed(F.col("s")).alias("next"))
    both = dealt.join(lent, "k")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("head", F.lit(1), half))
    both = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"), "next")
    both = with_signatures(both, "text", "signatures", chain, anchors).drop("text")
    both = with_signatures(both, "edited", "edited_signatures", chain, anchors)
    near = [likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"), likeness(F.col("signatures"), unpacked(F.col("next"))).alias("near_next")]
    return both.select("doc_id", "n_chars", "edited", "signatures", "edited_signatures", *near)


def search(queries: DataFrame, docs: DataFrame, least: float = 0.8, chain: int = CHAIN, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """(query_id, doc_id, likeness): all documents whose likeness to a query is ``least`` or more, a query's own row included.

    Equal sets are searched once. Sets are dealt by length into partitions whose ends differ by 1 / ``least``, so a set of length n meets its own
    partition and the two beside it only. Within those, two sets meet by a signature among the rarest (1 - ``least``) of each, of which two sets that
    are alike enough share one; what meets is pruned by length and compared exactly. Empty sets are alike. Null ids are kept.
    """
    ratio = math.log(1 / least)
    sets = fingerprints(docs, chain, anchors).select("doc_id", "signatures")
    asked = fingerprints(queries, chain, anchors).select(F.col("doc_id").alias("query_id"), "signatures")
    sets = hold(sets.withColumn("set", F.sha2(F.array_join("signatures", ""), 256)), "sets")
    asked = hold(asked.withColumn("set", F.sha2(F.array_join("signatures", ""), 256)), "asked")
    known = hold(sets.dropDuplicates(["set"]).select("set", "signatures"), "known")
    wanted = hold(asked.dropDuplicates(["set"]).select("set", "signatures"), "wanted")
    often = known.select(F.explode("signatures").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    often = hold(often, "often")

    def rare(of: DataFrame, beside: tuple[int, ...]) -> DataFrame:
        rows = of.select("set", F.size("signatures").alias("size"), F.explode("signatures").alias("s")).join(often, "s", "left")
        order = Window.partitionBy("set").orderBy(F.coalesce("n", F.lit(0)), "s")
        prefix = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1)
        part = F.floor(F.log("size") / ratio).cast("int")
        return prefix.select("set", "size", "s", F.explode(F.array(*(part + i for i in beside))).alias("length_part"))

    left = rare(wanted, (-1, 0, 1)).withColumnRenamed("set", "query_set").withColumnRenamed("size", "query_size")
    right = hold(rare(known, (0,)), "index")
    met = left.join(right, ["s", "length_part"]).where((F.least("size", "query_size") >= F.greatest("size", "query_size") * least - 1e-9))
    met = hold(met.select("query_set", "set").distinct(), "met")
    near = met.join(wanted.select(F.col("set").alias("query_set"), F.col("signatures").alias("asked")), "query_set").join(known, "set")
    near = near.withColumn("likeness", likeness(F.col("asked"), F.col("signatures"), least)).where(F.col("likeness") >= least).select("query_set", "set", "likeness")
    none = F.size("signatures") == 0
    empty = wanted.where(none).select(F.col("set").alias("query_set")).join(known.where(none).select("set"), F.col("query_set") == F.col("set")).select("query_set", "set", F.lit(1.0).alias("likeness"))
    pairs = hold(near.unionByName(empty), "near")
    out = pairs.join(asked.select("query_id", F.col("set").alias("query_set")), "query_set").join(sets.select("doc_id", "set"), "set")
    return out.select("query_id", "doc_id", "likeness")


def _oracle() -> str:
    anchors = ", ".join(f"'{a}'" for a in ANCHORS)

    def prints(name: str, of: str, text: str, more: str) -> str:
        return rf"""
{name}_words as (
  select {more}, {text}, list_filter(regexp_extract_all(lower({text}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from {of}
),
{name}_parts as (
  select *, list_filter(list_transform(w, lambda x, i: case when x in ({anchors}) then i end), lambda i: i is not null) as places,
    list_filter(w, lambda x: x not in ({anchors})) as c
  from {name}_words
),
{name}_all as (
  select *, list_filter(list_transform(places, lambda i, j: case when i - j + 1 <= len(c) then
    md5(concat_ws(' ', w[i], c[i - j + 1], c[i - j + 2]))[1:8] end), lambda s: s is not null) as s
  from {name}_parts
),
{name} as (
  select {more}, {text}, case when len(s) > 0 then list_sort(list_distinct(s)) when {text} = '' then []::varchar[] else [md5('=' || {text})[1:8]] end as s
  from {name}_all
)"""

    return rf"""
with docs as (select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n from documents),
ring as (
  select doc_id, t, n, coalesce(lead(doc_id) over o, first_value(doc_id) over o) as next_id,
    coalesce(lead(t) over o, first_value(t) over o) as next_text
  from docs window o as (order by doc_id desc)
),
texts as (select doc_id, next_id, n, t, left(t, (n - n // 2)::int) || left(next_text, (n // 2)::int) as e from ring),
{prints("own", "texts", "t", "doc_id, next_id, n, e")},
{prints("edited", "texts", "e", "doc_id")},
both_sets as (
  select a.doc_id, a.n, a.e, a.s, b.s as es, c.s as ns from own a join edited b on a.doc_id = b.doc_id join own c on a.next_id = c.doc_id
)
select doc_id, n as n_chars, sha256(e) as edited_sha256, array_to_string(s, ' ') as fingerprint, array_to_string(es, ' ') as edited_fingerprint,
  case when len(s) + len(es) = 0 then 1.0 else len(list_intersect(s, es))::double / (len(s) + len(es) - len(list_intersect(s, es))) end as near_edited,
  case when len(s) + len(ns) = 0 then 1.0 else len(list_intersect(s, ns))::double / (len(s) + len(ns) - len(list_intersect(s, ns))) end as near_next
from both_sets
"""


ORACLE_SQL = _oracle()
