"""Fill-in-the-middle, source divergence and SpotSigs: odd tables, brute force, and the SQL of the driver's smallest documents."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.llm import fill_in_middle, source_divergence, spotsigs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "a", "é", "<P> marked", "plain words of the house and of the garden", "😀é<" * 300, "x" * 300_000, "  \n\t", "the of and", "!!!", "same text", "same text"]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def clashing(docs, *names):
    return docs.withColumns({n: F.concat(F.lit("own "), F.col("doc_id").cast("string")) for n in names})


# ---- op11


def test_boundary_lists_find_every_code_point():
    rng = random.Random(5)
    texts = ["", "a", "é", "😀", "a" * 5000, "😀" * 3000, *("".join(rng.choice("aé中😀") for _ in range(rng.randrange(1, 6000))) for _ in range(12))]
    for text in texts:
        raw = text.encode()
        n, size, *parts = fill_in_middle.elias_fano(raw)
        assert (n, size) == (len(text), len(raw))
        want = np.cumsum([0, *(len(c.encode()) for c in text)])
        for i in {0, n, n // 2, *(rng.randrange(n + 1) for _ in range(40))}:
            assert fill_in_middle.select(i, *parts) == want[i]


def plain_cut(doc_id, text):
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_cuts_of_odd_tables_equal_plain_ones_and_restore(spark):
    rows = [(i * 7, t) for i, t in enumerate(ODD)] + [(None, "no id <"), (77, "the same row"), (77, "the same row"), (78, "<<PSM>> < P>")]
    docs = clashing(documents(spark, rows), "key", "salt", "n", "h1", "x", "low")
    out = fill_in_middle.transform(docs)
    got = sorted((tuple(r) for r in out.withColumn("own", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()), key=repr)
    assert got == sorted(((i, *plain_cut(i, t or ""), t or "") for i, t in rows), key=repr)
    assert fill_in_middle.transform(docs.limit(0)).collect() == []


def test_a_text_of_a_third_of_all_rows_is_spread_and_indexed_once_a_share(spark):
    rows = [(i, "one very common text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    index, members = fill_in_middle.text_index(documents(spark, rows))
    salts = [r[0] for r in index.where("text = 'one very common text'").select("salt").collect()]
    assert len(salts) == len(set(salts)) > 300
    assert index.where("text <> 'one very common text'").groupBy("text").count().where("count > 1").count() == 0
    assert members.groupBy("key", "salt").count().agg(F.max("count")).first()[0] < 20
    assert sorted(r[0] for r in fill_in_middle.transform(documents(spark, rows)).select("doc_id").collect()) == list(range(3000))


def test_texts_that_share_a_digest_stop_the_job(spark):
    docs = documents(spark, [(i, "one" if i % 2 else "two") for i in range(6000)])
    index, _ = fill_in_middle.text_index(docs, digest=F.encode(F.length("text").cast("string"), "UTF-8"))
    with pytest.raises(Exception, match="one digest"):
        index.collect()


# ---- op12


def plain_audit(rows, least=10, top=10):
    def terms(text):
        out, word = [], []
        for c in (text or "") + " ":
            if "a" <= c.lower() <= "z" and c.isascii() or ord(c) >= 128:
                word.append(c.lower() if c.isascii() else c)
            elif word:
                out.append("".join(word))
                word = []
        return out

    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, w = lang or "", source or "", terms(text)
        held[lang].update(set(w))
        counts[lang, source].update(w)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in held[lang].items() if n >= least), key=str.encode)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda n, of: 1 + 10**9 * (n + 2) // (of + 2 * len(kept))
        p = {s: [share(counts[lang, s][t], total[s]) for t in kept] for s in sources}
        q = [share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(map(f, p[s], p[o])), o.encode(), o) for o in sources if o != s]
            own = [(-f(a, b), t.encode(), t) for a, b, t in zip(p[s], q, kept, strict=True) if counts[lang, s][t] > 0 and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
                out += [(lang, s, part, t, -v, i) for i, (v, _, t) in enumerate(found, 1)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")


def test_divergence_equals_exact_plain_sums(spark):
    rng = random.Random(11)
    words = [*"abcdefgh", "é", "ü", "中", "Zoo", "zoo", "z1z"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 12))), rng.choice(["x", "y", None, ""]), rng.choice(["p", "q", "ä", None])) for _ in range(160)]
    rows += [("the same row", "x", "p")] * 12 + [(None, "x", "q"), ("", "only", "alone"), ("rare words", "v0", "p"), ("", "v0", "q")]
    docs = clashing(frame(spark, rows), "n", "term", "docs", "chunk", "value", "rank", "total", "all")
    want = sorted(plain_audit(rows))
    for cells in (1 << 19, 5):  # 5: a chunk for every term or two
        assert sorted(tuple(r) for r in source_divergence.audit(docs, cells=cells).collect()) == want
    assert source_divergence.audit(docs.limit(0)).collect() == []


def test_shares_are_exact_beyond_doubles():
    counts = np.array([0, 1, 7, 2**40, 2**45 - 5], np.int64)
    for total, size in ((3, 5), (10**9 + 7, 12345), (2**45, 10**6), (2**61, 3)):
        fits = counts[counts <= total]
        assert source_divergence.smoothed(fits, total, size).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 2 * size) for c in fits]


# ---- op13


def test_signatures_follow_anchors(spark):
    docs = documents(spark, [(1, "The old house of a red garden. THE old house"), (2, "without anchors"), (3, ""), (4, None), (5, "the"), (6, "!!!"), (7, "the old house of a red garden the old house")])
    got = {r["doc_id"]: r["signatures"] for r in spotsigs.fingerprints(docs).collect()}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()[:8]
    assert got[1] == got[7] == sorted({md5(x) for x in ("the old house", "of red garden", "a red garden")})
    assert got[2] == [md5("=without anchors")] and got[3] == got[4] == [] and got[5] == [md5("=the")] and got[6] == [md5("=!!!")]


def test_edited_texts_of_odd_tables(spark):
    rows = [(i * 5 - 20, t) for i, t in enumerate(ODD)] + [(None, "the last of the ids"), (500, "the row that is there twice"), (500, "the row that is there twice"), (501, "a é of 😀 the end")]
    docs = clashing(documents(spark, rows), "k", "half", "next", "_w", "_x", "_s", "s", "part", "head")
    got = spotsigs.edited_likeness(docs).collect()
    assert len(got) == len(rows)
    order = sorted({i for i, _ in rows}, key=lambda i: (i is None, -(i or 0)))
    text = {i: min(t or "" for j, t in rows if j == i) for i in order}
    sets = {i: r["signatures"] for i in order for r in got if r["doc_id"] == i}
    for r in got:
        own, after = text[r["doc_id"]], order[(order.index(r["doc_id"]) + 1) % len(order)]
        half = len(own) // 2
        assert r["n_chars"] == len(own) and r["edited"] == own[: len(own) - half] + text[after][:half]
        for b, near in ((r["edited_signatures"], r["near_edited"]), (sets[after], r["near_next"])):
            a = set(r["signatures"])
            assert near == (len(a & set(b)) / len(a | set(b)) if a | set(b) else 1.0)
    alone = spotsigs.edited_likeness(documents(spark, [(3, "abcd")])).first()
    assert (alone["edited"], alone["near_next"]) == ("abab", 1.0)
    assert spotsigs.edited_likeness(docs.limit(0)).collect() == []


def test_search_finds_all_that_brute_force_finds(spark):
    rng = random.Random(4)
    words = ["the", "of", "a", "is", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))]
    base = [" ".join(rng.choices(words, k=rng.randrange(20, 120))) for _ in range(30)]
    texts = [*base, *base[:5], *(" ".join(w for w in t.split() if rng.random() > 0.03) for t in base for _ in range(6)), "", None, "none here"]
    docs = documents(spark, list(enumerate(texts)))
    sets = {r["doc_id"]: set(r["signatures"]) for r in spotsigs.fingerprints(docs).collect()}
    asked = docs.where("doc_id % 3 = 0")
    for least in (0.8, 0.5):
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        want = {(i, j, like(sets[i], sets[j])) for i in sets if i % 3 == 0 for j in sets if like(sets[i], sets[j]) >= least}
        assert {tuple(r) for r in spotsigs.search(asked, docs, least).collect()} == want
