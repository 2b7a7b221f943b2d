"""Unified diffs, scopes and mentions as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritally.functions.expressions import normal, patched_files, production_python


def classify(corpus: DataFrame, patch: str = "patch") -> DataFrame:
    """corpus plus files_touched, targets (production Python among them), n_files, n_targets, single_file, eligible.

    A null patch touches no file. Where the corpus has its lists of graded tests, also n_fail_to_pass and n_pass_to_pass.
    """
    lists = {"n_fail_to_pass": "FAIL_TO_PASS", "n_pass_to_pass": "PASS_TO_PASS"}
    corpus = corpus.withColumns({n: F.size(c) for n, c in lists.items() if c in corpus.columns})
    out = corpus.withColumn("files_touched", patched_files(F.coalesce(patch, F.lit(""))))
    out = out.withColumn("targets", F.filter("files_touched", production_python))
    return out.withColumns(
        {
            "n_files": F.size("files_touched"),
            "n_targets": F.size("targets"),
            "single_file": F.size("files_touched") == 1,
            "eligible": F.size("targets") > 0,
        }
    )


def changed_lines(patches: DataFrame, key: str, patch: str = "patch") -> DataFrame:
    """(key, path, line): new-side line numbers that a unified diff adds, or where it removes.

    Windows run over one patch. The position is the hunk's start plus the kept and added lines before it in the hunk.
    """
    lines = patches.select(key, F.posexplode(F.split(patch, "\r?\n")).alias("pos", "text"))
    w = Window.partitionBy(key).orderBy("pos")
    path = F.when(F.regexp_extract("text", "^diff --git a/(.+?) b/(.+)$", 2) == "/dev/null", F.regexp_extract("text", "^diff --git a/(.+?) b/(.+)$", 1)).when(
        F.col("text").rlike("^diff --git a/.+? b/.+$"), F.regexp_extract("text", "^diff --git a/(.+?) b/(.+)$", 2)
    )
    start = F.when(F.col("text").rlike(r"^@@ -\d+"), F.regexp_extract("text", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).cast("int"))
    marked = lines.withColumn("path", F.last(path, True).over(w)).withColumn("hunk", F.count(start).over(w)).withColumn("start", F.last(start, True).over(w))
    sign = F.when(F.col("text").rlike(r"^(\+\+\+|---|diff --git |@@ -\d+)"), "").otherwise(F.substring("text", 1, 1))
    marked = marked.withColumn("sign", sign)
    inside = Window.partitionBy(key, "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("sign").isin("+", " ").cast("int")).over(inside), F.lit(0))
    out = marked.withColumn("line", (F.col("start") + before).cast("int"))
    return out.where("path is not null and sign in ('+', '-') and start is not null").select(key, "path", "line").distinct()


def in_spans(lines: DataFrame, spans: DataFrame, keys: list[str], width: int = 256) -> DataFrame:
    """(keys, symbol): definitions whose span first..last holds a line; nested owners match too."""
    return touching(lines.select(*keys, F.col("line").alias("a"), F.col("line").alias("b")), spans, keys, width)


def touching(hunks: DataFrame, spans: DataFrame, keys: list[str], width: int = 256) -> DataFrame:
    """(keys, symbol): spans that overlap a hunk a..b.

    A hunk overlaps a span if the furthest end of the hunks that begin up to the span's last line is not before its first line, so no hunk meets a span:
    that end is a running maximum within the block of ``width`` lines of the span's last line, or what the blocks before it reach. Work is
    linear in hunks and spans, however many lie on the same lines.
    """
    known = " and ".join(f"{k} is not null" for k in keys)
    block = lambda c: F.floor(F.col(c) / width).alias("block")
    h = hunks.where(f"a <= b and {known}").groupBy(*keys, "a").agg(F.max("b").alias("b")).select(*keys, block("a"), F.col("a").alias("at"), "b")
    s = spans.where(f"first <= last and {known}").select(*keys, block("last"), F.col("last").alias("at"), "symbol", "first").distinct()
    ends = h.groupBy(*keys, "block").agg(F.max("b").alias("b")).unionByName(s.select(*keys, "block").distinct().withColumn("b", F.lit(None).cast(h.schema["b"].dataType)))
    before = F.max("b").over(Window.partitionBy(*keys).orderBy("block").rangeBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("before", before).groupBy(*keys, "block").agg(F.max("before").alias("before"))  # a row for each block of a file
    rows = h.withColumn("hunk", F.lit(True)).unionByName(s.withColumn("hunk", F.lit(False)), allowMissingColumns=True)
    upto = F.max("b").over(Window.partitionBy(*keys, "block").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own = rows.withColumn("upto", upto).where("not hunk").join(ends, [*keys, "block"])
    return own.where(F.greatest("upto", "before") >= F.col("first")).select(*keys, "symbol").distinct()


def single_word_mentions(texts: DataFrame, words: DataFrame, key: str, text: str = "text", word: str = "word") -> DataFrame:
    """(key, word): texts that mention a word, by an equi-join on their distinct tokens rather than a text-by-word product."""
    token = F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]", " ")), " "))).alias(word)
    return texts.select(key, token).where(F.col(word) != "").join(words.select(F.lower(F.col(word)).alias(word)).distinct(), word).select(key, word)


def phrase_mentions(texts: DataFrame, phrases: DataFrame, key: str, lengths: list[int], text: str = "text", phrase: str = "phrase") -> DataFrame:
    """(key, phrase): texts that mention a phrase of one of these lengths in words, by an equi-join on their word n-grams.

    Text and phrase are normalised; runs of blanks are kept, so a phrase matches where its own spacing does.
    """
    w = texts.select(key, F.split(normal(F.col(text)), " ").alias("w"))

    def grams_of(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, n), " ")))

    grams = [w.select(key, F.explode(grams_of(n)).alias(phrase)) for n in lengths]
    wanted = phrases.select(normal(F.col(phrase)).alias(phrase)).distinct()
    every = grams[0]
    for g in grams[1:]:
        every = every.unionByName(g)
    return every.join(wanted, phrase).select(key, phrase).distinct()
