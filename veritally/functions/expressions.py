"""Column expressions of the audit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def rounded(x: Column, digits: int = 4) -> Column:
    """A reported fraction: rounded half to even."""
    return F.bround(x, digits)


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Lower and upper end of Wilson's interval, within 0 and 1, to four places; null for n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    low, high = F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)
    return rounded(F.when(n.isNotNull(), low)), rounded(F.when(n.isNotNull(), high))


def normal(text: Column) -> Column:
    """Lower case with a blank for each character that is no letter, digit or underscore; runs are not collapsed."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]", " "))


def mentions(text: Column, word: Column) -> Column:
    """Whether a normalised text holds a normalised word or phrase between blanks."""
    return F.contains(F.concat(F.lit(" "), normal(text), F.lit(" ")), F.concat(F.lit(" "), normal(word), F.lit(" ")))


def names_symbol(text: Column, name: Column) -> Column:
    """Whether a failure's text says that a name is missing, in one of the interpreter's or the mock's phrases (fixed values)."""

    def says(before: str, after: str) -> Column:
        return F.contains(text, F.concat(F.lit(before), name, F.lit(after)))

    module = says("module '", "'") & F.contains(text, F.lit("No module named"))
    return (
        says("has no attribute '", "'") | says("does not have the attribute '", "'") | says("name '", "' is not defined") | says("cannot import name '", "'") | module
    )


def rate_limited(text: Column) -> Column:
    """Whether a registry's answer is a refusal for its rate; null is not."""
    return F.coalesce(F.lower(text).rlike("429|toomanyrequests|too many requests"), F.lit(False))


def production_python(path: Column) -> Column:
    """Whether a path is Python that is no test, documentation or hidden file."""
    parts = F.split(F.lower(path), "/")
    leaf, parents = F.element_at(parts, -1), F.slice(parts, F.lit(1), F.size(parts) - 1)
    bad = F.exists(parents, lambda p: p.isin("test", "tests", "testing", "doc", "docs") | p.startswith("."))
    return path.endswith(".py") & ~bad & ~leaf.startswith("test_") & ~leaf.endswith("_test.py") & (leaf != "conftest.py")


def patched_files(patch: Column) -> Column:
    """Files of a unified diff in order, each once: the new name, or the old one where the file is deleted."""
    heads = F.regexp_extract_all(patch, F.lit(r"(?m)^(diff --git a/.+? b/.+)$"), F.lit(1))
    old = lambda h: F.regexp_extract(h, r"^diff --git a/(.+?) b/(.+)$", 1)
    new = lambda h: F.regexp_extract(h, r"^diff --git a/(.+?) b/(.+)$", 2)
    return F.array_distinct(F.transform(heads, lambda h: F.when(new(h) == "/dev/null", old(h)).otherwise(new(h))))


def label_operator(label: Column) -> Column:
    """What stands before the first colon of a log label."""
    return F.substring_index(label, ":", 1)


def label_anchor(label: Column) -> Column:
    """What stands after the first colon, null for no anchor; later colons stay."""
    rest = F.when(F.instr(label, ":") > 0, F.expr("1")).isNotNull()
    after = F.substring(label, F.instr(label, ":") + 1, F.length(label))
    return F.nullif(F.when(rest, after).otherwise(F.lit("")), F.lit("<no anchor>"))


def same_words(reason: Column) -> Column:
    """A reason with runs of white space as one blank; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(reason, F.lit("")), r"\s+", " "))


def first_of(*cols: Column) -> Column:
    """The first count that is present, as usage reports name it differently."""
    return F.coalesce(*cols)


def cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Price of a call by rates for a million tokens; null where the rate is unknown."""
    return tokens_in * rate_in / 1e6 + tokens_out * rate_out / 1e6


def occurrences(text: Column, part: Column) -> Column:
    """How often a part stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def replace_once(text: Column, old: Column, new: Column) -> Column:
    """The text with its only occurrence replaced; an error where there is none or several."""
    n = occurrences(text, old)
    return F.when(n == 1, F.replace(text, old, new)).otherwise(F.raise_error(F.concat(F.lit("expected one occurrence, found "), n.cast("string"))))


def rename_word(text: Column, old: str, new: str) -> Column:
    """Every whole-word occurrence renamed; the round trip has to restore the text and leave no residue."""
    done = F.regexp_replace(text, rf"\b{old}\b", new)
    back = F.regexp_replace(done, rf"\b{new}\b", old)
    whole = (back == text) & ~done.rlike(rf"\b{old}\b")
    return F.when(whole, done).otherwise(F.raise_error(F.lit(f"renaming {old} does not round-trip")))


def judge_answer(text: Column) -> Column:
    """(score, error) of an answer: the integer 0 to 10 under the top level's "score" of its outermost JSON object, or why there is none.

    7.0, true and numbers in strings are no integers. A bare score without an object is noted, never taken. An object that
    repeats a key is taken as malformed.
    """
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    value = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))  # within brackets, so that nothing may follow the object
    value = F.when(F.try_variant_get(value, "$[1]", "variant").isNull(), value)
    kind = F.schema_of_variant(F.try_variant_get(value, "$[0].score", "variant"))
    score = F.try_variant_get(value, "$[0].score", "bigint")
    bare = F.regexp_extract(text, r'"score"\s*:\s*(-?\d+)', 1)
    error = (
        F.when(F.coalesce(text, F.lit("")) == "", "empty response")
        .when((body == "") & (bare != ""), F.concat(F.lit("no JSON object; a bare score field was present ("), bare, F.lit(")")))
        .when(body == "", "no JSON object in response")
        .when(value.isNull(), "json decode error")
        .when(F.coalesce(kind, F.lit("")) != "BIGINT", "score is not an integer")
        .when(~score.between(0, 10), "score out of range")
    )
    return F.struct(F.when(error.isNull(), score.cast("int")).alias("score"), error.alias("error"))


def judge_score(text: Column) -> Column:
    """The integer score 0 to 10 of an answer; null for anything else."""
    return judge_answer(text)["score"]


def sorted_json(fields: dict) -> Column:
    """JSON text of named columns, keys in order, with a blank after each comma and colon; letters beyond ASCII stay as they are.

    Values are columns, lists of columns or dictionaries of the same.
    """
    if isinstance(fields, Column):
        inner = F.to_json(F.struct(fields.alias("x")))
        return F.when(fields.isNull(), F.lit("null")).otherwise(F.substring(inner, F.lit(6), F.length(inner) - 6))
    if isinstance(fields, list | tuple):
        return F.concat(F.lit("["), F.concat_ws(", ", *map(sorted_json, fields)), F.lit("]"))
    parts = [F.concat(F.lit(f'"{name}": '), sorted_json(fields[name])) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def payload_digest(fields: dict) -> Column:
    """sha256 of a payload's ``sorted_json``, by which calls with one payload are told."""
    return F.sha2(sorted_json(fields), 256)


def image_ref(instance_id: Column, namespace: str = "ns", arch: str = "x86_64") -> Column:
    """The image of a task; a double underscore is written as _1776_."""
    return F.concat(F.lit(f"{namespace}/sweb.eval.{arch}."), F.replace(instance_id, F.lit("__"), F.lit("_1776_")))


def capped(text: Column, most: int) -> tuple[Column, Column]:
    """(text cut to a cap, whether the cap fired)."""
    return F.substring(text, 1, most), F.coalesce(F.length(text) > most, F.lit(False))
