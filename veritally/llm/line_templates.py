"""Line deduplication by a log-template tree, in DataFrame operations only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import hold

DEPTH = 3
AGREE = 0.8


def _keys(docs: DataFrame) -> DataFrame:
    """docs with ka, kb: 128 bits that stand for a row's id and text."""
    return docs.withColumn("ka", F.xxhash64("doc_id", "text")).withColumn("kb", F.xxhash64(F.lit(7), "text", "doc_id"))


def _trimmed(line: Column) -> Column:
    """A line without blanks, tabs and returns at its ends; btrim goes over a line's every character, so others are left alone."""
    ends = functools.reduce(Column.__or__, (f(F.lit(c)) for c in " \t\r" for f in (line.startswith, line.endswith)))
    return F.when(ends, F.btrim(line, F.lit(" \t\r"))).otherwise(line)


def _masked(line: Column) -> Column:
    """A trimmed line with each token that has a digit as <*>.

    A match begins at a token's beginning only and never backtracks, so a token of any length takes linear time. Lines without
    a digit are left alone.
    """
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(?<![^ \t])[^ \t0-9]*+[0-9][^ \t]*+", "<*>")).otherwise(line)


def _lines(docs: DataFrame) -> DataFrame:
    """(ka, kb, doc_id, line, m) of every line that holds more than blanks, tabs and returns; line counts from 0."""
    cut = docs.select("ka", "kb", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    cut = cut.select("ka", "kb", "doc_id", "line", _trimmed(F.col("raw")).alias("t")).where("t <> ''")  # masking leaves no line empty
    return cut.select("ka", "kb", "doc_id", "line", _masked(F.col("t")).alias("m"))


def _single(m: Column) -> Column:
    """A masked line with one blank between its tokens."""
    return F.when(m.contains("\t") | m.contains("  "), F.regexp_replace(m, "[ \t]+", " ")).otherwise(m)


def line_templates(docs: DataFrame, depth: int = DEPTH, agree: float = AGREE) -> DataFrame:
    """(ka, kb, doc_id, line, t1, t2): the template of every line, as 128 bits.

    A line falls through the tree by its number of tokens and its first ``depth`` tokens to a leaf; tokens with a
    digit are variable from the start. A leaf holds several groups of lines. The different lines of a leaf vote: each
    token counts how many of them have it at its position. Of a line of n tokens, up to (1 - ``agree``) * n may be variable:
    with the votes of its tokens in order, the smallest beyond so many is the size of the line's group, and the tokens with
    fewer votes than that are the group's variable fields. So lines of one group come to one template, whatever other groups
    share their leaf; a line without such fields is its own template. As a fifth of fewer than five tokens is none, lines of under five tokens have no variable
    field but tokens with digits, nor have the first ``depth`` tokens of any line, by which it falls. Votes are aggregations, so the order of lines does
    not matter.
    """
    n, single = F.col("n"), F.col("single")
    lines = _lines(docs).withColumn("single", _single(F.col("m")))
    # all lines are only counted at their blanks and cut after the first tokens; those of a leaf with several are split below
    lines = lines.withColumn("n", F.octet_length(single) - F.octet_length(F.replace(single, F.lit(" "), F.lit(""))) + 1)
    lines = lines.select(
        "ka", "kb", "doc_id", "line",
        F.xxhash64("m").alias("h1"), F.xxhash64(F.lit(1), "m").alias("h2"),
        F.xxhash64(n, F.substring_index(single, " ", depth)).alias("leaf"), F.floor(F.lit(round(1 - agree, 6)) * n).cast("int").alias("free"),
    )
    lines = hold(lines, "lines")
    several = lines.where("free > 0").groupBy("leaf").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("leaf")
    several = hold(several, "leaves")  # a table of its own, so that a join with it can split a leaf with very many lines
    # one document for each different line of those leaves lends the words
    member = lines.join(several, "leaf").groupBy("leaf", "h1", "h2").agg(F.min(F.struct("ka", "kb", "line")).alias("at"))
    wanted = member.groupBy("at.ka", "at.kb").agg(F.collect_list(F.struct(F.col("at.line").alias("line"), "leaf", "h1", "h2")).alias("wanted"))
    texts = docs.select("ka", "kb", "text").join(wanted.hint("shuffle_hash"), ["ka", "kb"])
    split = texts.select("wanted", F.explode(F.array(F.split("text", "\n", -1))).alias("raw"))  # a one-row explode, so that a text is split once
    line = F.transform(F.array_distinct("wanted"), lambda x: F.struct(x["leaf"].alias("leaf"), x["h1"].alias("h1"), x["h2"].alias("h2"), F.get("raw", x["line"]).alias("t")))
    one = split.select(F.explode(line).alias("x"))
    words = one.select("x.leaf", "x.h1", "x.h2", _masked(_trimmed(F.col("x.t"))).alias("m")).distinct()
    words = words.select("leaf", "h1", "h2", F.split(_single(F.col("m")), " ", -1).alias("w"))
    words = words.select("leaf", "h1", "h2", F.size("w").alias("size"), F.posexplode("w").alias("at", "token"))
    words = hold(words.select("leaf", "h1", "h2", "size", "at", F.xxhash64("token").alias("word")), "words")  # a token is only told from others at its place
    votes = words.groupBy("leaf", "at", "word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # tokens that no other line has at their place are only counted, as they are variable in any group
    voted = words.join(hold(votes, "votes"), ["leaf", "at", "word"])
    # tokens are dealt out by line first: in a part by place nearly every one is its line's only token, so that lists made there are only sorted and moved
    own = voted.repartition("leaf", "h1", "h2", "size").groupBy("leaf", "h1", "h2", "size").agg(F.collect_list(F.struct("at", "word", "n")).alias("w"))  # a line's own tokens
    own = own.withColumn("alone", F.col("size") - F.size("w"))
    free = F.floor(F.lit(round(1 - agree, 6)) * F.col("size"))
    # one-row explodes, so that the group's size and the arrays are made once rather than for each token
    group = F.explode(F.array(F.get(F.sort_array("w.n"), (free - F.col("alone")).cast("int")))).alias("group")
    own = own.where(F.col("alone") <= free).select("leaf", "h1", "h2", "size", "w", group)
    kept = F.explode(F.array(F.filter("w", lambda x: x["n"] >= F.col("group")))).alias("kept")
    own = own.select("leaf", "h1", "h2", "size", kept).where(F.size("kept") < F.col("size"))
    # a template is its number of tokens and the fixed ones with their places
    fixed = F.sort_array(F.transform(F.filter("kept", lambda x: x["word"] != F.xxhash64(F.lit("<*>"))), lambda x: F.struct(x["at"].alias("at"), x["word"].alias("word"))))
    fixed = own.select("leaf", "h1", "h2", "size", F.explode(F.array(fixed)).alias("fixed"))
    general = fixed.select("leaf", "h1", "h2", F.xxhash64("size", "fixed").alias("g1"), F.xxhash64(F.lit(1), "size", "fixed").alias("g2"))
    named = lines.join(general, ["leaf", "h1", "h2"], "left")
    return named.select("ka", "kb", "doc_id", "line", F.coalesce("g1", "h1").alias("t1"), F.coalesce("g2", "h2").alias("t2"))


def drop_recurring_lines(docs: DataFrame, depth: int = DEPTH, agree: float = AGREE) -> DataFrame:
    """docs with two more columns, n_lines and n_dropped, and each text without its recurring lines.

    A template that several documents share is kept at its first line (smallest doc_id, then line) and dropped
    everywhere else; templates within one document only are left alone. Documents are told apart by id and text, so
    repeated rows count as one and come back alike. Blank lines stay. Null texts stay null with 0 lines; an empty
    text has 1. Other columns pass through unchanged, whatever their names; columns named n_lines or n_dropped are replaced.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    keyed = _keys(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in own)).alias("row")))
    lines = hold(line_templates(keyed.select("ka", "kb", "doc_id", "text"), depth, agree), "templates")
    first = F.min(F.struct("doc_id", "line", "ka", "kb")).alias("first")
    shared = lines.groupBy("t1", "t2").agg(first, F.min("ka").alias("a"), F.max("ka").alias("b")).where("a <> b").select("t1", "t2", "first")
    gone = lines.join(hold(shared, "shared"), ["t1", "t2"]).where("not (ka = first.ka and kb = first.kb and line = first.line)")
    gone = hold(gone.groupBy("ka", "kb").agg(F.collect_set("line").alias("gone")), "gone")  # a table, so that the join can split the copies of one row
    out = keyed.join(gone.hint("shuffle_hash"), ["ka", "kb"], "left")
    # the one-row explode keeps the split from being done anew for every line; array_except hashes, so time is linear in lines
    out = out.select("row", "text", "gone", F.explode(F.array(F.split("text", "\n", -1))).alias("raw"))
    raw = F.col("raw")
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), F.col("gone")), lambda i: F.get(raw, i)), "\n")
    return out.select(
        *(F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in own),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(raw)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )


ORACLE_SQL = r"""
with lines as (
  select doc_id, line, regexp_replace(trim(raw, chr(32) || chr(9) || chr(13)), '[^ \t]*[0-9][^ \t]*', '<*>', 'g') as m
  from (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents)
),
full_lines as (select *, string_split_regex(m, '[ \t]+') as w from lines where m <> ''),
leaves as (select *, len(w) as n, w[1:3] as head from full_lines),
distinct_lines as (select distinct n, head, m, w from leaves),
words as (select n, head, m, unnest(w) as word, generate_subscripts(w, 1) as pos from distinct_lines),
votes as (select n, head, pos, word, count(*) as c from words group by all),
voted as (select *, (list_sort(list(c) over (partition by n, head, m)))[floor(n / 5)::int + 1] as own from words join votes using (n, head, pos, word)),
general as (
  select n, head, m, string_agg(case when c < own then '<*>' else word end, ' ' order by pos) as template
  from voted group by n, head, m having bool_or(c < own)
),
templates as (
  select doc_id, line, coalesce(chr(10) || general.template, leaves.m) as own
  from leaves left join general on leaves.n = general.n and leaves.head = general.head and leaves.m = general.m
),
ranked as (
  select *, row_number() over (partition by own order by doc_id, line) as r,
    min(doc_id) over (partition by own) as a, max(doc_id) over (partition by own) as b
  from templates
),
gone as (select doc_id, line from ranked where a <> b and r > 1),
parts as (
  select doc_id, line, raw, exists (select 1 from gone where gone.doc_id = x.doc_id and gone.line = x.line) as lost
  from (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents) x
)
select doc_id, count(*)::bigint as n_lines, sum(lost::int)::bigint as n_dropped,
  coalesce(string_agg(raw, chr(10) order by line) filter (where not lost), '') as text
from parts group by doc_id
"""
