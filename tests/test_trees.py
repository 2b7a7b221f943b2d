"""Transforms of sources: known trees, table functions, and reach through imports against a plain search."""

import ast
import random

import pytest
from pyspark.sql import functions as F

from veritally.operators import gates, sources, trees

FILES = [
    ("longer_name", "shop/cart.py", "class Cart:\n    total = 0\n"),
    ("longer_name", "shop/till.py", "import math\n\nfrom shop.cart import Cart, EmptyCart\n\nopened = [Cart(), EmptyCart()]\nrate = math.pi\n"),
    ("same_prefix", "shop/cart.py", "def weigh(goods):\n    return sum(goods)\n"),
    ("same_prefix", "shop/scale.py", "from shop.weighing import weigh\n\n\nasync def ask(by: 'weigh' = None):\n    return (by or weigh)([1, 2])\n"),
    ("qualified", "pkg/mod.py", "def _run(x):\n    return list(x)\n"),
    ("qualified", "pkg/use.py", "from pkg import mod\n\n\ndef é():\n    return 'é', mod._run(1)\n"),
    ("dynamic", "pkg/mod.py", "__all__ = ['Foo']\n\n\nclass Foo:\n    def m(self):\n        raise ValueError(\"bad value\")\n"),
    ("attribute", "pkg/mod.py", "class Foo:\n    pass\n\n\ndef other(x):\n    return x.Foo\n"),
    ("broken", "pkg/mod.py", "class Foo:\n    pass\n"),
    ("broken", "pkg/old.py", "print 'x'\n"),
    ("named", "pkg/mod.py", "class Foo:\n    pass\n"),
    ("ranked", "pkg/mod.py", "class Foo:\n    pass\n"),
    ("ranked", "pkg/_in.py", "x = 'Foo'\n"),
    ("ranked", "pkg/a.py", "\n" * 9 + "x = 'Foo'\ny = 'a Foo'\n"),
    ("ranked", "pkg/b.py", "x = 'Foo'\n"),
]

RENAMED = [
    ("longer_name", "shop/cart.py", "Cart", "APPLIED", None, "shop/cart.py", "class Cart__renamed:\n    total = 0\n"),
    ("longer_name", "shop/cart.py", "Cart", "APPLIED", None, "shop/till.py", "import math\n\nfrom shop.cart import Cart__renamed, EmptyCart\n\nopened = [Cart__renamed(), EmptyCart()]\nrate = math.pi\n"),
    ("same_prefix", "shop/cart.py", "weigh", "APPLIED", None, "shop/cart.py", "def weigh__renamed(goods):\n    return sum(goods)\n"),
    ("same_prefix", "shop/cart.py", "weigh", "APPLIED", None, "shop/scale.py", "from shop.weighing import weigh__renamed\n\n\nasync def ask(by: 'weigh__renamed' = None):\n    return (by or weigh__renamed)([1, 2])\n"),
    ("qualified", "pkg/mod.py", "_run", "APPLIED", None, "pkg/mod.py", "def _run__renamed(x):\n    return list(x)\n"),
    ("qualified", "pkg/mod.py", "_run", "APPLIED", None, "pkg/use.py", "from pkg import mod\n\n\ndef é():\n    return 'é', mod._run__renamed(1)\n"),
    ("dynamic", "pkg/mod.py", "Foo", "REFUSED", "dynamic reach in pkg/mod.py line 1 (an entry of __all__)", None, None),
    ("ranked", "pkg/mod.py", "Foo", "REFUSED", "dynamic reach in pkg/_in.py line 1; 3 more", None, None),
    ("attribute", "pkg/mod.py", "Foo", "REFUSED", "attribute access in pkg/mod.py line 6", None, None),
    ("broken", "pkg/mod.py", "Foo", "REFUSED", "does not parse: pkg/old.py", None, None),
    ("named", "pkg/mod.py", "Foo", "REFUSED", "the issue names it", None, None),
]

PATCHES = [
    (1, "diff --git a/t.py b/t.py\n--- a/t.py\n+++ b/t.py\n@@ -1,3 +1,4 @@\n from m import (\n     a,\n+    sym,\n )\n+x = sym(1)", "sym"),
    (2, "diff --git a/n.py b/n.py\nnew file mode 100644\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,3 @@\n+def test():\n+    from m import sym\n+    sym()", "sym"),
    (3, "diff --git a/t.py b/t.py\n--- a/t.py\n+++ b/t.py\n@@ -1,2 +1,2 @@\n sym()\n-sym(1)\n+sym(2)", "sym"),
    (4, "diff --git a/t.py b/t.py\n--- a/t.py\n+++ b/t.py\n@@ -1,2 +1,2 @@\n sym()\n+symbol()", "sym"),
]

ISSUES = [("named", "Please fix Foo."), ("dynamic", "Something else")]
ORIGINS = [(1, "introduced", "in_test,module_import"), (2, "new_file", "in_test,local_import"), (3, "mixed", "in_test"), (4, "pre_existing", "")]
TREE = "tree string, path string, text string"


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, TREE)


@pytest.fixture(scope="module")
def issues(spark):
    return spark.createDataFrame(ISSUES, "tree string, issue string")


def test_renames_of_known_trees(files, issues):
    places = sources.occurrences(files)
    anchors = sources.rename_anchors(places).where("name in ('Foo', '_run', 'Cart', 'weigh')")
    assert {(r["tree"], r["path"], r["name"], r["tier"]) for r in anchors.where("tree in ('qualified', 'same_prefix')").collect()} == {("qualified", "pkg/mod.py", "_run", "HIGH"), ("same_prefix", "shop/cart.py", "weigh", "MEDIUM")}
    assert sorted(map(tuple, sources.rename(files, places, anchors, issues).collect()), key=str) == sorted(RENAMED, key=str)


def test_rewrites_of_known_trees(files, issues):
    text = dict((r[:2], r[2]) for r in FILES)
    got = [tuple(r) for r in sources.reword_messages(files, issues).collect()]
    assert got == [("dynamic", "pkg/mod.py", "bad value", "APPLIED", text["dynamic", "pkg/mod.py"].replace('"bad', '"[reworded] bad'))]
    got = [tuple(r) for r in sources.reverse_returns(files).collect()]
    assert got == [("qualified", "pkg/mod.py", 2, text["qualified", "pkg/mod.py"].replace("list(x)", "list(reversed(list(x)))"))]


def test_origins_of_known_patches(spark):
    got = sources.patch_origin(spark.createDataFrame(PATCHES, "id int, patch string, symbol string"), "id").collect()
    assert sorted(map(tuple, got)) == ORIGINS


ODD = [
    ("a", "_in/x.py", "def é(x):\n    return list(x)  # é\n\n\nclass K:\n    async def m(self):\n        def inner():\n            return list(y for y in (1, 2))\n        raise ValueError('single')\n"),
    ("b", "y.py", "def broken(:\n"),
    ("c", "z.py", None),
    ("d", "w.py", "def f():\n    return list(\n        (1,))\n    raise ValueError(f'{1}')\n    raise ValueError\n    raise\n\n\nasync def g():\n    pass\n"),
    ("e", "null\0.py", "x = 1\0"),
]


def test_anchors_of_odd_files_never_fail(spark):
    found = trees.anchors(spark.createDataFrame(ODD, TREE))
    got = {(r["tree"], r["operator"], r["label"], r["func"], r["tier"], r["note"]) for r in found.collect()}
    assert got == {
        ("a", "symbol_rename", "é", "é", "MEDIUM", "public in a private package"), ("a", "symbol_rename", "K", "K", "MEDIUM", "public in a private package"),
        ("a", "collection_reverse", "é:2", "é", "MEDIUM", "returns a list"), ("a", "collection_reverse", "K:8", "K", "MEDIUM", "returns a list"), ("a", "message_reword", "single", "K", "MEDIUM", "plain message"),
        ("b", None, "y.py", None, None, "does not parse"), ("d", "symbol_rename", "f", "f", "MEDIUM", "public"), ("e", None, "null\0.py", None, None, "does not parse"),
    }
    assert trees.anchors(spark.createDataFrame([], TREE)).collect() == []


def test_applications_apply_or_refuse(spark):
    issue = spark.createDataFrame([("a", "the Single one")], "tree string, issue string")
    out = trees.applications(spark.createDataFrame(ODD, TREE), issue).collect()
    got = {(r["tree"], r["operator"], r["label"]): (r["status"], r["reason"]) for r in out}
    assert got["a", "message_reword", "single"] == ("REFUSED", "the issue quotes it")
    assert got["b", None, None] == got["e", None, None] == ("REFUSED", "does not parse")
    assert {k for k, v in got.items() if v == ("APPLIED", None)} == {("a", "symbol_rename", "é"), ("a", "symbol_rename", "K"), ("a", "collection_reverse", "é:2"), ("a", "collection_reverse", "K:8"), ("d", "symbol_rename", "f")}
    for r in out:
        if r["status"] == "APPLIED":
            ast.parse(r["text"])
            assert (r["path"] is not None) and r["text"] != dict((x[0], x[2]) for x in ODD)[r["tree"]]


def closure(defs, named, stars, lists, listed):
    known, todo = {}, [((m, n, m, n), 0) for m, n in defs]
    while todo:
        (m, n, at, alias), hops = todo.pop(0)
        if (m, n, at, alias) in known:
            continue
        known[m, n, at, alias] = hops
        todo += [((m, n, to, new), hops + 1) for source, name, to, new in named if (source, name) == (at, alias)]
        given = (at, alias) in listed if at in lists else not alias.startswith("_")
        todo += [((m, n, to, alias), hops + 1) for source, to in stars if source == at and given]
    return {(*k, v) for k, v in known.items()}


def test_reach_equals_a_plain_search_with_cycles(spark):
    rng = random.Random(2)
    names = ["a", "_b", "c", "d"]
    for _ in range(3):
        defs, named, stars, lists, listed, rows = set(), set(), set(), set(), set(), []
        for m in range(9):
            text = []
            for _ in range(rng.randrange(1, 5)):
                other, x, y = rng.randrange(9), rng.choice(names), rng.choice(names)
                kind = rng.randrange(4)
                if kind == 0:
                    text.append(f"def {x}():\n    pass")
                    defs.add((f"p.m{m}", x))
                elif kind == 1:
                    text.append(f"from p.m{other} import {x} as {y}")
                    named.add((f"p.m{other}", x, f"p.m{m}", y))
                elif kind == 2:
                    text.append(f"from .m{other} import *")
                    stars.add((f"p.m{other}", f"p.m{m}"))
                else:
                    text.append(f"__all__ = ['{x}', '{y}']")
                    lists.add(f"p.m{m}")
                    listed |= {(f"p.m{m}", x), (f"p.m{m}", y)}
            rows.append(("t", f"p/m{m}.py", "\n".join(text)))
        got = trees.reach(trees.import_edges(spark.createDataFrame(rows, TREE)))
        assert {tuple(r)[1:] for r in got.collect()} == closure(defs, named, stars, lists, listed)


def test_references_follow_aliases_and_modules(spark):
    rows = [
        ("t", "p/__init__.py", "from .core import Thing as Public\n"), ("t", "p/core.py", "class Thing:\n    pass\n\n\nx = Thing()\n"), ("t", "use.py", "from p import Public\nfrom p import core\nimport p.core as k\n\ny = (Public(), core.Thing, k.Thing, other.Thing)\n"),
        ("t", "q/core.py", "class Thing:\n    pass\n"), ("u", "use.py", "from p import Public\n\nPublic()\n"),
    ]
    files = spark.createDataFrame(rows, TREE)
    edges = trees.import_edges(files)
    got = trees.references(sources.occurrences(files), edges, trees.reach(edges)).where("module = 'p.core'").groupBy("path", "how").agg(F.sort_array(F.collect_list("line")).alias("lines")).collect()
    assert {(r["path"], r["how"]): r["lines"] for r in got} == {("p/core.py", "name"): [1, 5], ("use.py", "name"): [1, 5], ("use.py", "attribute"): [5, 5]}


def test_gates_hold_only_if_each_part_does(spark):
    cells = []
    over = {"pass": {}, "coupled": {("repaired", "mut1"): (0.0, 5, True, "t1")}, "survivor": {("repaired", "mut1"): (1.0, 5, False, "")}, "absent": {("repaired", "mut1"): (0.0, 3, False, "t1")}, "drift": {("repaired", "mut1"): (0.0, 5, False, "t2")}}
    for task, own in over.items():
        for variant in ("original", "repaired"):
            for solution in ("gold", "gold_renamed", "mut1"):
                reward = 0.0 if solution == "mut1" or (variant, solution) == ("original", "gold_renamed") else 1.0
                cells.append((task, variant, solution, solution == "mut1", *own.get((variant, solution), (reward, 5, False, "t1" if solution == "mut1" else ""))))
    df = spark.createDataFrame(cells, "task string, variant string, solution string, is_mutant boolean, reward double, present int, names_symbol boolean, failing string")
    got = {r["task"]: (r["c1"], r["c2"], r["g1"], r["c3"]) for r in gates.gate_verdict(df.withColumn("failing", F.filter(F.split("failing", ","), lambda x: x != ""))).collect()}
    assert got == {"pass": (True,) * 4, "coupled": (True, False, True, True), "survivor": (True, False, True, False), "absent": (True, False, True, True), "drift": (True, True, True, False)}
