"""Source code as rows: definitions and occurrences of names; renames and one-line rewrites decided by joins.

Parsing is a small per-file helper; scopes, refusals and which edits a rename makes are Spark joins and aggregations
over its rows. Bad sources give a row of kind 'error' and never fail a query.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.functions.expressions import mentions

_WORD = re.compile(rb"[A-Za-z_]\w*")
OCCURRENCE = "tree string, path string, name string, kind string, line int, c0 int, c1 int, last int, qualifier string"


def _file_rows(source: str) -> list[tuple]:
    """(name, kind, line, c0, c1, last, qualifier) of one file; columns count UTF-8 bytes, as the parser's do."""
    try:
        root = ast.parse(source)
    except (SyntaxError, ValueError):
        return [("", "error", 0, 0, 0, 0, "")]
    raw, out = [x.encode() for x in source.split("\n")], []
    top = {id(n) for n in root.body}
    hints: set[int] = set()
    listed = {id(x) for n in ast.walk(root) if isinstance(n, ast.Assign | ast.AugAssign) and any(getattr(t, "id", "") == "__all__" for t in getattr(n, "targets", [getattr(n, "target", None)])) for x in ast.walk(n.value)}
    for n in ast.walk(root):
        noted = [n.annotation] if isinstance(n, ast.arg | ast.AnnAssign) else [n.returns] if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef) else []
        hints |= {id(x) for a in noted if a is not None for x in ast.walk(a)}
    for n in ast.walk(root):
        at = getattr(n, "lineno", 0)
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            c = re.compile(rb"(?:def|class)\s+").search(raw[at - 1], n.col_offset).end()
            kind = "def" if id(n) not in top else "async_def" if isinstance(n, ast.AsyncFunctionDef) else "top_def"
            out.append((n.name, kind, at, c, c + len(n.name.encode()), n.end_lineno, ""))
        elif isinstance(n, ast.Name):
            out.append((n.id, "name", at, n.col_offset, n.end_col_offset, n.end_lineno, ""))
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                if a.asname is None:
                    out.append((a.name, "import" if a.lineno == at else "split_import", a.lineno, a.col_offset, a.end_col_offset, a.end_lineno, n.module or ""))
        elif isinstance(n, ast.Import):
            out += [((a.asname or a.name).split(".")[-1], "module", at, 0, 0, at, "") for a in n.names]
        elif isinstance(n, ast.Attribute):
            owner = n.value.id if isinstance(n.value, ast.Name) else ""
            out.append((n.attr, "attribute", n.end_lineno, n.end_col_offset - len(n.attr.encode()), n.end_col_offset, n.end_lineno, owner))
        elif isinstance(n, ast.Constant) and isinstance(n.value, str):
            if id(n) in hints and n.lineno == n.end_lineno:
                seg = raw[at - 1][n.col_offset : n.end_col_offset]
                out += [(m[0].decode(), "annotation", at, n.col_offset + m.start(), n.col_offset + m.end(), at, "") for m in _WORD.finditer(seg)]
            else:
                out += [(w.decode(), "string", at, 0, 0, n.end_lineno, "__all__" if id(n) in listed else "") for w in {m[0] for m in _WORD.finditer(n.value.encode("utf-8", "replace"))}]
    return out


def occurrences(files: DataFrame) -> DataFrame:
    """One row for each place of each name in files (tree, path, text)."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in OCCURRENCE.split(", ")]
        for f in it:
            yield pd.DataFrame([(t, p, *r) for t, p, s in f[["tree", "path", "text"]].itertuples(index=False) for r in _file_rows(s or "")], columns=names)

    return files.select("tree", "path", "text").mapInPandas(parse, OCCURRENCE)


def definitions(places: DataFrame) -> DataFrame:
    """(tree, path, symbol, first, last): spans of definitions, for scope joins."""
    return places.where("kind in ('def', 'top_def', 'async_def')").select("tree", "path", F.col("name").alias("symbol"), F.col("line").alias("first"), "last")


def rename_anchors(places: DataFrame) -> DataFrame:
    """(tree, path, name, tier): module-level definitions; private ones are HIGH, all others MEDIUM."""
    tier = F.when(F.startswith("name", F.lit("_")), "HIGH").otherwise("MEDIUM")
    return places.where("kind = 'top_def'").select("tree", "path", "name", tier.alias("tier"))


def rename(files: DataFrame, places: DataFrame, anchors: DataFrame, issues: DataFrame, suffix: str = "__renamed") -> DataFrame:
    """(tree, target, name, status, reason, path, text): each anchor's renamed files, or one REFUSED row with null path.

    anchors: tree, path, name. issues: tree, issue. Refused are names that the issue mentions, that a string outside
    annotations holds (the strongest such place is told: an entry of __all__ first, then public paths, then by path and line, and
    how many others there are), that an import splits over lines, that an attribute access reaches other than through the
    defining module, and trees with a file that does not parse. Each changed file has to round-trip.
    """
    own = anchors.select("tree", F.col("path").alias("target"), "name")
    key = ["tree", "target", "name"]
    module = F.regexp_extract("target", r"([^/]+)\.py$", 1)
    hits = own.join(places, ["tree", "name"])
    qualified = (F.col("kind") == "attribute") & (F.col("qualifier") == module)
    reason = (
        F.when(F.col("kind") == "split_import", F.concat(F.lit("import over several lines in "), "path"))
        .when((F.col("kind") == "attribute") & ~qualified, F.concat(F.lit("attribute access in "), "path", F.lit(" line "), F.col("line").cast("string")))
    )
    broken = places.where("kind = 'error'").groupBy("tree").agg(F.min(F.concat(F.lit("does not parse: "), "path")).alias("broken"))
    private = F.exists(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), lambda x: F.startswith(x, F.lit("_")))
    order = F.struct((F.col("qualifier") != "__all__").alias("plain"), private.alias("private"), "path", "line")
    strings = F.col("kind") == "string"
    refusals = hits.groupBy(*key).agg(F.min(F.when(strings, order)).alias("x"), F.count_if(strings).alias("n"), F.min(reason).alias("other"))
    more = F.when(F.col("n") > 1, F.concat(F.lit("; "), (F.col("n") - 1).cast("string"), F.lit(" more"))).otherwise("")
    entry = F.when(F.col("x.plain"), "").otherwise(" (an entry of __all__)")
    told = F.concat(F.lit("dynamic reach in "), "x.path", F.lit(" line "), F.col("x.line").cast("string"), entry, more)
    refusals = refusals.select(*key, F.coalesce(told, "other").alias("reach"))
    named = own.join(issues, "tree", "left").select(*key, F.when(F.coalesce(mentions(F.col("issue"), F.col("name")), F.lit(False)), "the issue names it").alias("named"))
    decided = named.join(broken, "tree", "left").join(refusals, key, "left").select(*key, F.coalesce("named", "broken", "reach").alias("reason"))
    edits = hits.where("kind in ('name', 'def', 'top_def', 'async_def', 'import', 'annotation', 'attribute')")
    edits = edits.groupBy(*key, "path").agg(F.collect_set(F.struct("line", "c0", "c1")).alias("edits"))
    work = decided.where("reason is null").select(*key).join(edits, key).join(files.select("tree", "path", "text"), ["tree", "path"])

    def apply(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in it:
            texts = []
            for name, edits, text in f[["name", "edits", "text"]].itertuples(index=False):
                lines = [x.encode() for x in text.split("\n")]
                for line, c0, c1 in sorted(((e["line"], e["c0"], e["c1"]) for e in edits), reverse=True):
                    lines[line - 1] = lines[line - 1][:c0] + (name + suffix).encode() + lines[line - 1][c1:]
                new = b"\n".join(lines).decode()
                texts.append(new if re.sub(rf"\b{re.escape(name + suffix)}\b", name, new) == text else None)
            yield f[["tree", "target", "name", "path"]].assign(text=texts)

    done = work.select(*key, "path", "edits", "text").mapInPandas(apply, "tree string, target string, name string, path string, text string")
    ok = done.select(*key, F.when(F.col("text").isNull(), "REFUSED").otherwise("APPLIED").alias("status"), F.when(F.col("text").isNull(), "no round trip").alias("reason"), "path", "text")
    refused = decided.where("reason is not null").select(*key, F.lit("REFUSED").alias("status"), "reason", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("text"))
    return ok.unionByName(refused)


_RAISE = r"""(?m)^\s*raise\s+\w+\(\s*"([^"\\\n{}]+)"\s*\)"""


def reword_messages(files: DataFrame, issues: DataFrame) -> DataFrame:
    """(tree, path, message, status, text): each plain message of a one-line raise, marked where it is unique in its file.

    A message that the issue quotes, or that occurs more than once, is refused.
    """
    found = files.select("tree", "path", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_RAISE), F.lit(1)))).alias("message"))
    quoted = F.concat(F.lit('"'), "message", F.lit('"'))
    n = (F.length("text") - F.length(F.replace("text", quoted, F.lit("")))) / F.length(quoted)
    out = found.join(issues, "tree", "left")
    refused = F.coalesce(F.contains(F.lower("issue"), F.lower("message")), F.lit(False)) | (n != 1)
    new = F.replace("text", quoted, F.concat(F.lit('"[reworded] '), "message", F.lit('"')))
    return out.select("tree", "path", "message", F.when(refused, "REFUSED").otherwise("APPLIED").alias("status"), F.when(~refused, new).alias("text"))


def reverse_returns(files: DataFrame) -> DataFrame:
    """(tree, path, line, text): each one-line ``return list(...)`` as ``return list(reversed(list(...)))``; order is then unvalidated."""
    lines = files.select("tree", "path", "text", F.posexplode(F.split("text", "\n")).alias("at", "line_text"))
    hit = lines.where(F.col("line_text").rlike(r"^\s*return list\([^()]*(\([^()]*\)[^()]*)*\)\s*$"))
    new = F.regexp_replace("line_text", r"^(\s*return )(list\(.*\))\s*$", "$1list(reversed($2))")
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i == F.col("at"), F.col("new")).otherwise(x)), "\n")
    return hit.withColumn("new", new).select("tree", "path", (F.col("at") + 1).alias("line"), text.alias("text"))


def patch_origin(patches: DataFrame, key: str, patch: str = "patch", symbol: str = "symbol") -> DataFrame:
    """(key, origin, kinds): where a test patch refers to a symbol - introduced, new_file, mixed or pre_existing - and how.

    The state of parenthesised imports runs over the new side, kept and added lines alike, so an added line within an
    unchanged import head is an import. kinds: module_import, local_import, in_test, of added lines.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy("pos")
    lines = patches.select(key, F.col(symbol).alias("symbol"), F.posexplode(F.split(patch, "\r?\n")).alias("pos", "t"))
    lines = lines.withColumn("file", F.count(F.when(F.col("t").rlike("^diff --git a/.+ b/.+$"), 1)).over(w)).where("file > 0")
    f = Window.partitionBy(key, "file").orderBy("pos")
    is_new = F.max(F.col("t").rlike(r"^--- /dev/null\s*$")).over(Window.partitionBy(key, "file"))
    body = F.expr("substr(t, 2)")
    lines = lines.withColumn("is_new", is_new).withColumn("body", body)
    lines = lines.where(~F.col("t").rlike(r"^(\+\+\+|---|@@|index |new file|deleted file|similarity|rename |diff --git )") & F.col("t").rlike(r"^[-+ ]"))
    new_side = ~F.startswith("t", F.lit("-"))
    head = new_side & F.col("body").rlike(r"^\s*(from|import)\b")
    opens = head & F.contains("body", F.lit("(")) & ~F.contains("body", F.lit(")"))
    closes = new_side & F.contains("body", F.lit(")")) & ~opens
    before = F.last(F.when(opens, F.when(F.col("body").rlike(r"^[ \t]"), "local").otherwise("module")).when(closes, "closed"), True).over(f.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("head", head).withColumn("state", F.coalesce(before, F.lit("closed")))
    word = F.expr(r"body rlike concat('\\b\\Q', symbol, '\\E\\b')")
    added = F.startswith("t", F.lit("+"))
    kind = (
        F.when(F.col("head"), F.when(F.col("body").rlike(r"^[ \t]"), "local_import").otherwise("module_import"))
        .when(F.col("state") != "closed", F.concat("state", F.lit("_import")))
        .otherwise("in_test")
    )
    hits = lines.where(word).groupBy(key).agg(
        F.count_if(added).alias("n_added"), F.count_if(~added).alias("n_context"), F.min(F.when(added, F.col("is_new"))).alias("all_new"),
        F.array_join(F.sort_array(F.collect_set(F.when(added, kind))), ",").alias("kinds"),
    )
    out = patches.select(key).join(hits, key, "left")
    origin = F.when((F.col("n_added") > 0) & (F.col("n_context") > 0), "mixed").when(F.col("n_added") > 0, F.when(F.col("all_new"), "new_file").otherwise("introduced")).otherwise("pre_existing")
    return out.select(key, origin.alias("origin"), F.coalesce("kinds", F.lit("")).alias("kinds"))


def witness_origins(witnesses: DataFrame, corpus: DataFrame, key: str = "instance_id", patch: str = "test_patch") -> DataFrame:
    """witnesses plus origin and kinds: where each task's test patch refers to the witness's symbol.

    witnesses: key, symbol. Each task's patch is looked through once for each of its symbols.
    """
    asked = witnesses.select(key, "symbol").distinct().join(corpus.select(key, F.col(patch).alias("patch")), key)
    found = patch_origin(asked.withColumn("asked", F.struct(key, "symbol")), "asked")
    return witnesses.join(found.select(F.col("asked")[key].alias(key), F.col("asked.symbol").alias("symbol"), "origin", "kinds"), [key, "symbol"])
