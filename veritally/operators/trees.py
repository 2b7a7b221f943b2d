"""Transforms as table functions over source files, and where a definition is reached through imports.

What may be done to a file is a lateral join with a table function: each file gives rows of anchors, each anchor a row that says APPLIED or REFUSED and why.
Reach is a transitive closure over rows of import edges, computed by joins.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veritally.functions.expressions import mentions
from veritally.operators import sources
from veritally.tables import cut

ANCHOR = StructType().add("operator", "string").add("label", "string").add("func", "string").add("line", "integer").add("tier", "string").add("note", "string")
OUTCOME = StructType().add("status", "string").add("reason", "string").add("new_text", "string")
OPERATORS = ("symbol_rename", "collection_reverse", "message_reword")


def _one_line_list(node: ast.AST) -> bool:
    call = node.value if isinstance(node, ast.Return) else None
    return isinstance(call, ast.Call) and isinstance(call.func, ast.Name) and call.func.id == "list" and node.lineno == node.end_lineno


def _message(node: ast.AST) -> str | None:
    call = node.exc if isinstance(node, ast.Raise) else None
    one = call.args[0] if isinstance(call, ast.Call) and len(call.args) == 1 and not call.keywords else None
    return one.value if isinstance(one, ast.Constant) and isinstance(one.value, str) and one.value and one.lineno == one.end_lineno else None


class Anchors:
    """The places of one file to which an operator may be applied; one row without an operator for a file that does not parse."""

    def eval(self, path: str, text: str) -> Iterator[tuple]:
        try:
            root = ast.parse(text or "")
        except (SyntaxError, ValueError) as e:
            yield None, path, None, int(getattr(e, "lineno", None) or 0), None, "does not parse"
            return
        inner_package = any(p.startswith("_") for p in path.split("/")[:-1])
        for node in root.body:
            if isinstance(node, ast.FunctionDef | ast.ClassDef):
                private = node.name.startswith("_")
                note = "private by its name" if private else "public in a private package" if inner_package else "public"
                yield OPERATORS[0], node.name, node.name, node.lineno, "HIGH" if private else "MEDIUM", note
        stack: list[tuple[ast.AST, str | None]] = [(root, None)]
        while stack:
            node, within = stack.pop()
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                within = within or node.name  # the definition of the module that a scope would list
            if _one_line_list(node):
                yield OPERATORS[1], f"{within or ''}:{node.lineno}", within, node.lineno, "MEDIUM", "returns a list"
            if (said := _message(node)) is not None:
                yield OPERATORS[2], said, within, node.lineno, "MEDIUM", "plain message"
            stack += [(x, within) for x in ast.iter_child_nodes(node)]


class Outcomes:
    """One row for an anchor of an operator that changes one file only: the new text, or why it is refused."""

    def eval(self, operator: str, label: str, line: int, text: str, issue: str) -> Iterator[tuple]:
        if operator == OPERATORS[1]:
            lines = text.split("\n")
            node = next((x for x in ast.walk(ast.parse(text)) if _one_line_list(x) and x.lineno == line), None)
            if node is None:
                yield "REFUSED", "no such return", None
                return
            raw = lines[line - 1].encode()
            a, b = node.value.col_offset, node.value.end_col_offset
            lines[line - 1] = (raw[:a] + b"list(reversed(" + raw[a:b] + b"))" + raw[b:]).decode()
            yield "APPLIED", None, "\n".join(lines)
        elif operator == OPERATORS[2]:
            quoted = f'"{label}"'
            if issue and label.lower() in issue.lower():
                yield "REFUSED", "the issue quotes it", None
            elif text.count(quoted) != 1:
                yield "REFUSED", f"{text.count(quoted)} places hold it", None
            else:
                yield "APPLIED", None, text.replace(quoted, f'"[reworded] {label}"')


anchors_of = F.udtf(Anchors, returnType=ANCHOR)
outcome_of = F.udtf(Outcomes, returnType=OUTCOME)


def anchors(files: DataFrame) -> DataFrame:
    """(tree, path, ANCHOR): a lateral join of files (tree, path, text) with the places of each. Never fails; a file that does not parse has one row
    with a null operator."""
    return files.lateralJoin(anchors_of(F.col("path").outer(), F.coalesce(F.col("text").outer(), F.lit("")))).select("tree", "path", *ANCHOR.names)


def applications(files: DataFrame, issues: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(tree, target, operator, label, line, status, reason, path, text): what comes of each anchor; refusals are rows with null path and text.

    issues: tree, issue. A file that does not parse has a REFUSED row. A rename has a row for each file that it changes, decided over the tree's
    files by ``sources.rename``; the other operators change the anchor's file only. Anchors and places are kept, as each is asked several times and
    files are to be parsed once for either.
    """
    found = cut(anchors(files)) if found is None else found
    broken = found.where("operator is null").select("tree", F.col("path").alias("target"), F.lit(None).cast("string").alias("operator"), F.lit(None).cast("string").alias("label"), "line", F.lit("REFUSED").alias("status"), F.col("note").alias("reason"))
    names = found.where(F.col("operator") == OPERATORS[0]).select("tree", "path", F.col("label").alias("name"), "line")
    places = cut(sources.occurrences(files))
    renamed = sources.rename(files, places, names.select("tree", "path", "name").distinct(), issues)
    renamed = renamed.join(names.groupBy("tree", F.col("path").alias("target"), "name").agg(F.min("line").alias("line")), ["tree", "target", "name"])
    renamed = renamed.select("tree", "target", F.lit(OPERATORS[0]).alias("operator"), F.col("name").alias("label"), "line", "status", "reason", "path", "text")
    own = found.where(F.col("operator").isin(*OPERATORS[1:])).join(files.select("tree", "path", "text"), ["tree", "path"]).join(issues, "tree", "left")
    done = own.lateralJoin(outcome_of(*(F.col(c).outer() for c in ("operator", "label", "line", "text", "issue"))))
    done = done.select("tree", F.col("path").alias("target"), "operator", "label", "line", "status", "reason", F.when(F.col("status") == "APPLIED", F.col("path")).alias("path"), F.col("new_text").alias("text"))
    none = [F.lit(None).cast("string").alias(c) for c in ("path", "text")]
    return broken.select("*", *none).unionByName(renamed).unionByName(done)


IMPORT = "tree string, path string, module string, kind string, source string, name string, alias string"


def module_of(path: str) -> str:
    """The dotted name of a file: pkg/a.py is pkg.a, and pkg/__init__.py is pkg."""
    parts = re.sub(r"\.py$", "", path).split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def _imports(path: str, text: str) -> list[tuple]:
    """(kind, source, name, alias): def (a definition or __all__ entry), from, star, module (alias stands for source)."""
    try:
        root = ast.parse(text)
    except (SyntaxError, ValueError):
        return [("error", "", "", "")]
    package = module_of(path).split(".") if path.endswith("/__init__.py") else module_of(path).split(".")[:-1]
    out = [("def", "", n.name, n.name) for n in root.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    for n in ast.walk(root):
        if isinstance(n, ast.ImportFrom):
            base = package[: len(package) - n.level + 1] if n.level else []
            source = ".".join([*base, *filter(None, [n.module])])
            out += [("star", source, "*", "*") if a.name == "*" else ("from", source, a.name, a.asname or a.name) for a in n.names]
        elif isinstance(n, ast.Import):
            out += [("module", a.name, "", a.asname or a.name) for a in n.names]
        elif isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets):
            out += [("listed", "", c.value, c.value) for c in ast.walk(n.value) if isinstance(c, ast.Constant) and isinstance(c.value, str)]
            out.append(("lists", "", "", ""))
    return out


def import_edges(files: DataFrame) -> DataFrame:
    """IMPORT rows of files (tree, path, text): definitions, imports, entries of __all__; a file that does not parse has one row of kind error."""
    names = [c.split()[0] for c in IMPORT.split(", ")]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(t, p, module_of(p), *r) for t, p, s in f[["tree", "path", "text"]].itertuples(index=False) for r in _imports(p, s or "")], columns=names)

    return files.select("tree", "path", "text").mapInPandas(parse, IMPORT)


def reach(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(tree, module, name, at, alias, hops): every module ``at`` in which the definition ``name`` of ``module`` goes by ``alias``, its own with 0 hops.

    Definitions follow imports by name and under other names, and star imports: those of a module with __all__ pass its entries, others all
    names without a leading underscore. What one round adds goes into the next alone (semi-naive), joined by (tree, module, name) and for stars by
    (tree, module); cycles end, as what is known is not added again. hops is the least number of imports. A name bound twice in a module stands for
    both. Imports within functions count as the module's.
    """
    cols = ["tree", "module", "name", "at", "alias"]
    edges = cut(edges)
    named = edges.where("kind = 'from'").select("tree", F.col("source").alias("at"), F.col("name").alias("alias"), F.col("module").alias("to"), F.col("alias").alias("as")).distinct()
    stars = edges.where("kind = 'star'").select("tree", F.col("source").alias("at"), F.col("module").alias("to")).distinct()
    lists = edges.where("kind = 'lists'").select("tree", F.col("module").alias("at"), F.lit(True).alias("lists")).distinct()
    listed = edges.where("kind = 'listed'").select("tree", F.col("module").alias("at"), F.col("name").alias("alias"), F.lit(True).alias("listed")).distinct()
    fresh = edges.where("kind = 'def'").select("tree", "module", "name", F.col("module").alias("at"), F.col("name").alias("alias")).distinct().withColumn("hops", F.lit(0))
    fresh = known = cut(fresh)
    for hops in range(1, most_rounds + 1):
        by_name = fresh.join(named, ["tree", "at", "alias"]).select("tree", "module", "name", F.col("to").alias("at"), F.col("as").alias("alias"))
        given = fresh.join(stars, ["tree", "at"]).join(lists, ["tree", "at"], "left").join(listed, ["tree", "at", "alias"], "left")
        given = given.where(F.coalesce("listed", F.coalesce(~F.col("lists"), F.lit(True)) & ~F.startswith("alias", F.lit("_"))))
        by_star = given.select("tree", "module", "name", F.col("to").alias("at"), "alias")
        fresh = cut(by_name.union(by_star).distinct().join(known.select(cols), cols, "left_anti").withColumn("hops", F.lit(hops)))
        if fresh.isEmpty():
            return known
        known = cut(known.union(fresh))
    raise RuntimeError(f"imports did not settle in {most_rounds} rounds")


def references(places: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(tree, module, name, path, line, c0, c1, how): places in code at which a definition is meant, by name or through a module's name.

    places: ``sources.occurrences`` of the same files. how is name or attribute; an attribute counts where its owner is an import of the module in which
    the definition goes by that name.
    """
    at = edges.select("tree", "path", F.col("module").alias("at")).distinct()
    own = places.join(at, ["tree", "path"])
    plain = own.where("kind in ('name', 'def', 'top_def', 'async_def', 'import', 'annotation')").withColumnRenamed("name", "alias").withColumn("how", F.lit("name"))
    whole = edges.where("kind = 'module'").select("tree", "path", F.col("alias").alias("qualifier"), F.col("source").alias("of"))
    part = edges.where("kind = 'from'").select("tree", "path", F.col("alias").alias("qualifier"), F.concat_ws(".", F.nullif("source", F.lit("")), "name").alias("of"))
    modules = at.select("tree", F.col("at").alias("of")).distinct()
    owners = whole.unionByName(part).distinct().join(modules, ["tree", "of"])
    dotted = own.where("kind = 'attribute' and qualifier <> ''").join(owners, ["tree", "path", "qualifier"])
    dotted = dotted.select("tree", "path", F.col("of").alias("at"), F.col("name").alias("alias"), "line", "c0", "c1", F.lit("attribute").alias("how"))
    met = plain.select("tree", "path", "at", "alias", "line", "c0", "c1", "how").unionByName(dotted).join(reached, ["tree", "at", "alias"])
    return met.select("tree", "module", "name", "path", "line", "c0", "c1", "how").distinct()


def mentioned(found: DataFrame, issues: DataFrame) -> DataFrame:
    """Anchors with named: whether the tree's issue names what they change; without an issue it does not."""
    return found.join(issues, "tree", "left").withColumn("named", F.coalesce(mentions(F.col("issue"), F.col("label")), F.lit(False))).drop("issue")
