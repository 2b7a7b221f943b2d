"""Each training-data operator against brute force, an exact round trip, SQL, or held-out accuracy."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tests import oracle
from veritally.llm import (
    compression_quality,
    graph,
    labels,
    latent_decontamination,
    license_scan,
    line_templates,
    packing,
    perplexity,
    queries,
    sharding,
    simhash,
    suffix_repeats,
    toxicity,
)

SF = oracle.SF
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")


def driver_texts():
    return [r[0] for r in oracle.connect().sql("select text from documents order by doc_id").fetchall()]


@pytest.fixture(scope="module")
def duck():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    oracle.compare(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], duck)


# ---- op1


def test_line_templates_generalise_and_keep_the_first(spark):
    texts = [
        "user 17 logged in\nalone here",
        "first line\nuser 99 logged in\nuser 100 logged in",
        "the quick brown fox jumps over one lazy dog today",
        "the quick brown fox jumps over two lazy dog today",
        "within\nwithin",
    ]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_templates.drop_recurring_lines(documents(spark, texts)).collect()}
    assert got[0] == (texts[0], 2, 0)
    assert got[1] == ("first line", 3, 2)
    assert got[2] == (texts[2], 1, 0) and got[3] == ("", 1, 1)
    assert got[4] == ("within\nwithin", 2, 0)


def test_a_leaf_holds_several_groups(spark):
    one = [f"job on node was started by {w} at the front desk today" for w in ("ann", "bob", "cid", "dan", "eve", "fay")]
    two = [f"job on node ended with state {w} after its last retry there" for w in ("red", "tan", "sky", "ash")]
    other = ["job on node alpha beta gamma delta epsilon zeta eta theta iota"]
    texts = [x for pair in zip(one, two + other, strict=False) for x in pair] + one[5:]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(documents(spark, texts)).collect()}
    kept = [t for i, t in enumerate(texts) if not got[i]["n_dropped"]]
    assert kept == [one[0], two[0], *other]


def test_long_tokens_and_many_lines_take_linear_time(spark):
    many = "\n".join(f"line {'x' * (i % 7 + 1)} {'y' * (i % 11 + 1)} {'z' * (i % 13 + 1)}" for i in range(60_000))
    texts = ["a" * 400_000, "b" * 200_000 + "7 tail", many, many + "\nown words at the end"]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_templates.drop_recurring_lines(documents(spark, texts)).collect()}
    assert got[0] == (texts[0], 1, 0) and got[1] == (texts[1], 1, 0)
    assert got[2][2] == 60_000 - len(got[2][0].split("\n")) and got[2][0].startswith("line x y z\n")
    assert got[3] == ("own words at the end", 60_001, 60_000)


def test_lines_keep_columns_with_clashing_names(spark):
    names = ("ka", "kb", "gone", "raw", "row", "line", "m", "t1", "a.b")
    docs = documents(spark, ["same line\nx", "same line\ny"]).withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in names})
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(docs).collect()}
    assert all(got[i][c] == f"{c} of {i}" for i in (0, 1) for c in names)
    assert (got[0]["text"], got[1]["text"]) == ("same line\nx", "y")


# ---- op2


def held_out_auc(s, y):
    rank = np.argsort(np.argsort(s)) + 1
    p, n = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * n)


def test_toxicity_learns_words_from_document_labels_and_locates_sentences(spark):
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(200)]

    def text(bad):
        own = [" ".join(rng.choices(plain, k=8)) for _ in range(rng.randint(1, 6))]
        if bad:
            own[rng.randrange(len(own))] += f" nasty{rng.randint(0, 99)}"
        return ". ".join(own) + "."

    model = toxicity.train([(text(k), k) for k in (0, 1) for _ in range(300)])
    y = np.array([0, 1] * 100)
    texts = [text(k) for k in y]
    s = np.array([model.score(t) for t in texts])
    assert held_out_auc(s, y) > 0.98 and ((s >= 0.7) == y).mean() > 0.95
    found = toxicity.locate(documents(spark, texts), model).collect()
    assert {r["doc_id"] for r in found} == set(np.flatnonzero(s >= 0.7))
    assert np.mean(["nasty" in r["sentence"] for r in found]) > 0.95
    assert all(texts[r["doc_id"]][r["first"] : r["last"]] == r["sentence"] for r in found)


def test_sentences():
    text = "  One two. Three?!\n\n . four\n" + " " * 500_000 + "five" + "\t" * 500_000
    assert [text[a:b].strip() for a, b in toxicity.sentences(text)] == ["One two.", "Three?!", "four", "five"]
    assert toxicity.sentences(" \n\t.!? \u00a0") == []


def test_toxicity_without_both_classes_is_constant(spark):
    assert 0 < toxicity.train([("a", 1)] * 3).score("x") < 1
    assert 0 < toxicity.train([]).score("") < 1


# ---- op3


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        lost = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                lost[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], lost.astype(int)])) == 1).sum())
        out.append((len(b), int(lost.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~lost])))
    return out


@pytest.mark.parametrize("length, hot, seed", [(400, 8192, 1), (400, 3, 2), (100, 8192, 3), (100, 2, 4)])
def test_repeats_are_those_of_brute_force(spark, length, hot, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.choice([50, 300, 900, 2500]))) for _ in range(10)]
    texts = [None, "", "x" * 3000, "xy" * 900, "z" * (length - 1), "z" * length]
    for _ in range(40):
        t = ""
        for _ in range(rng.randint(1, 5)):
            b = rng.choice(base)
            i = rng.randint(0, len(b))
            t += b[i : rng.randint(i, len(b))] + "".join(rng.choice("pqrs") for _ in range(rng.choice([0, 0, 7, 60])))
        texts.append(t)
    texts += texts[6:9]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in suffix_repeats.remove_repeats(documents(spark, texts).repartition(3), length, hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, length)


def test_repeated_rows_take_linear_time(spark):
    rng = random.Random(17)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    docs = spark.range(2000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text")).union(documents(spark, [text[:399], "x" + text[700:1200]]).select("doc_id", "text"))
    for hot in (8192, 500):
        got = {(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"])) for r in suffix_repeats.remove_repeats(docs, hot=hot).collect()}
        assert got == {(5, 3000, 3000, 1), (0, 399, 0, 0), (1, 501, 500, 1)}


def test_equal_runs_are_those_of_bytes():
    own, other = b"abcdefghij", b"xxabcdXfghij"
    assert suffix_repeats.equal_runs(own, other, 2, 0, 10, 4) == [(0, 4), (5, 10)]
    assert suffix_repeats.equal_runs(own, other, 2, 0, 10, 5) == [(5, 10)]
    assert suffix_repeats.equal_runs(own, other, 2, 1, 10, 4) == [(5, 10)]


def test_window_hashes_are_independent():
    a = np.frombuffer(b"\x01\x04" * 1000, np.uint8)
    b = np.frombuffer(b"\x04\x01" * 1000, np.uint8)
    (w, v), (x, y) = suffix_repeats.window_hashes(a, 400), suffix_repeats.window_hashes(b, 400)
    assert w[0] != x[0] and v[0] != y[0] and w[1] == x[0] and v[1] == y[0]


def test_suffix_sort_orders_and_measures_like_plain_sorting():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = np.array([len(t) for t in texts])
    begin, size = np.array([0, 25]), np.array([25, 35])
    for forward in (True, False):
        place = np.cumsum(n) - (n if forward else 0)
        order, lcp = suffix_repeats.Suffixes(raw, suffix_repeats.prefix_hashes(raw), place, n, forward).sort(begin, size)
        for lo, hi in ((0, 25), (25, 60)):
            own = [texts[i] if forward else texts[i][::-1] for i in order[lo:hi]]
            assert own == sorted(own)
            for a, b, k in zip(own, own[1:], lcp[lo + 1 : hi], strict=False):
                assert a[:k] == b[:k] and a[k : k + 1] != b[k : k + 1] or k == min(len(a), len(b))


# ---- op4


def brute_rules(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_rules_are_those_of_brute_force(spark):
    texts = [*driver_texts(), None, "", " \n\t", "a b a b a b a", "#x# <é> y\nq\nq\n \n q", "  x\x85y"]
    got = {r["doc_id"]: r for r in perplexity.quality_rules(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_rules(t)
        assert tuple(got[i][c] for c in perplexity._COUNTS) == want
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    good = [r["kept"] for r in got.values() if not r["base_failed"]]
    assert np.mean(good) > 0.8


def plain_tokens(text):
    """Words of letters, digits and characters beyond ASCII, and single marks."""
    out, word = [], ""
    for c in text + " ":
        if c.isascii() and not c.isalnum():
            out += [word] * (word != "") + [c] * (c not in " \t\n\r\x0b\x0c")
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def plain_model(texts, least_word, least_share, least_count):
    """Modified Kneser-Ney over tokens by dictionaries of tuples; returns the words and p(n-gram's last token | the tokens before it)."""
    order, all_tokens = perplexity.ORDER, [plain_tokens(t) for t in texts]
    often = Counter(w for t in all_tokens for w in t)
    words = {w for w, c in often.items() if c >= max(sum(often.values()) * least_word, least_count)}
    padded = lambda t: ["<pad>"] * (order - 1) + [w if w in words else "<unknown>" for w in t]
    raw = {order: Counter()}
    for t in map(padded, all_tokens):
        raw[order].update(tuple(t[i : i + order]) for i in range(len(t) - order + 1))
    n = {order: dict(raw[order])}
    for k in range(order - 1, 0, -1):
        raw[k], n[k] = Counter(), Counter()
        for g, c in raw[k + 1].items():
            raw[k][g[1:]] += c
            n[k][g[1:]] += 1
    floor = max(sum(raw[order].values()) * least_share, least_count)
    d = {k: perplexity.discounts([sum(c == i for c in n[k].values()) for i in (1, 2, 3, 4)]) for k in n}
    total, mass = Counter(), Counter()
    for k in n:
        for g, c in n[k].items():
            total[k, g[:-1]] += c
            if raw[k][g] >= floor:
                mass[k, g[:-1]] += c - d[k][min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / (len(words) + 2)
        k, c = len(g), n[len(g)].get(g, 0)
        own = (c - d[k][min(c, 3) - 1]) / total[k, g[:-1]] if c and raw[k][g] >= floor else 0
        back = 1 - mass[k, g[:-1]] / total[k, g[:-1]] if mass[k, g[:-1]] else 1
        return own + back * p(g[1:])

    return words, padded, p


@pytest.mark.parametrize("least_word, least_share, least_count", [(0, 0, 1), (1e-3, 1e-4, 1), (2**-14, 0, 3), (5e-3, 2e-3, 3)])
def test_model_is_that_of_a_plain_one_and_sums_to_one(spark, least_word, least_share, least_count):
    texts = [t for t in driver_texts()[:12] if t]
    docs = documents(spark, texts)
    vocabulary = perplexity.vocabulary(docs, F.lit(0), least_word, least_count)
    model = perplexity.kneser_ney(perplexity.gram_counts(docs, F.lit(0), vocabulary), vocabulary, least_share, least_count)[0]
    words, padded, p = plain_model(texts, least_word, least_share, least_count)
    assert {w.decode() for w in model.words} == words and list(model.words) == sorted(model.words)
    for t in [texts[0][:400], texts[3][-300:], "nothing like it: zqxj \u00e9\u4e2d", "..", " ", ""]:
        b = padded(plain_tokens(t))
        want = [math.log(p(tuple(b[i : i + perplexity.ORDER]))) for i in range(len(b) - perplexity.ORDER + 1)]
        got = model.log_perplexity(t)
        assert got is None if not want else got == pytest.approx(-np.mean(want), rel=1e-5)
    ids = np.arange(len(words) + 2, dtype=np.uint64)
    for context in ((0, 0), (1, 1), (2, 3), (5, len(words) + 1)):
        code = (context[0] << perplexity.BITS | context[1]) << perplexity.BITS
        assert np.exp(model.log_p(np.uint64(code) + ids).astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_the_verdict_is_that_of_the_model_and_not_of_marks(spark):
    """Texts with the same words and marks in another order have the same share of marks, bytes and letters; only the model tells them."""
    rng = random.Random(6)
    parts = [["the", "a", "this"], [f"noun{i}" for i in range(90)], ["is", "was"], [f"state{i}" for i in range(90)], [",", "."]]
    prose = [" ".join(rng.choice(p) for _ in range(rng.randrange(20, 60)) for p in parts) for _ in range(200)]
    mixed = [" ".join(rng.sample(t.split(" "), len(t.split(" ")))) for t in prose[:5]]
    got = {r["doc_id"]: r["kept"] for r in perplexity.quality_rules(documents(spark, prose + mixed)).collect() if not r["base_failed"]}
    assert not any(got[i] for i in range(200, 205) if i in got) and sum(got.values()) > 190
    marks = [sum(not c.isalnum() and c != " " for c in t) / len(t) for t in prose + mixed]
    assert marks[200:] == marks[:5]


def test_bands_are_by_language_of_any_name_and_alphabet(spark):
    rng = random.Random(12)
    alphabets = {"en": "abcdefghijklmnop", "xx": "\u03b1\u03b2\u03b3\u03b4\u03b5\u03b6\u03b7\u03b8", "zh": "".join(map(chr, range(0x4E00, 0x4E40)))}
    words = {k: ["".join(rng.choices(a, k=rng.randint(2, 6))) for _ in range(80)] for k, a in alphabets.items()}
    rows = []
    for lang, own in words.items():
        rows += [(lang, " ".join(rng.choices(own, k=rng.randint(80, 200)))) for _ in range(150)]
    bad = {
        len(rows): ("en", " ".join("".join(rng.choices(alphabets["en"], k=5)) for _ in range(120))),  # noise in the right alphabet
        len(rows) + 1: ("xx", " ".join(rng.choices(words["zh"], k=120))),  # the wrong language
        len(rows) + 2: ("zh", " ".join("".join(rng.choices(alphabets["zh"], k=4)) for _ in range(120))),
        len(rows) + 3: ("xx", " ".join(rng.choices(words["en"], k=120))),
    }
    rows += bad.values()
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in perplexity.quality_rules(docs).collect()}
    assert not any(got[i]["kept"] for i in bad), [(got[i]["log_ppl"], sorted(r["log_ppl"] for r in got.values() if r["model"] == got[i]["model"])[::30]) for i in bad]
    assert np.mean([r["kept"] for i, r in got.items() if i not in bad]) > 0.98
    again = {r["doc_id"]: r["kept"] for r in perplexity.quality_rules(docs.repartition(7)).collect()}
    assert again == {i: r["kept"] for i, r in got.items()}


# ---- op5


def test_ids_are_those_of_the_tokenizers_library():
    exact = public_tokenizers.path("byte_bpe_50k.json")
    fast, slow = packing.encoder(RANKS, public_tokenizers.PATTERN, exact), packing.encoder(exact)
    for t in [*driver_texts(), "", " ", "a  b\n\n c", "<|endoftext|> x", "日本語 🙂 é", "x" * 500, "1234567 ''s 's"]:
        assert fast(t) == slow(t)


def test_ids_of_long_runs_and_added_tokens(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    exact = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(exact)  # as it comes
    texts = [" " * 1_000_000, "\n" * 1_000_000, " \t\n" * 300_000 + "end", "a" * 1_000_000, "".join(rng.choices("abc", k=100_000)), "#" * 1_000_000, "7" * 100_000]
    texts += ["a <|endoftext|> b", "\u3000" * 5000, ("x" + " " * 400) * 50, " " * 511 + "y", " " * 512 + "y"]
    got = packing.token_pieces(documents(spark, texts), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, exact=exact)
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got.collect()}
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        ends = [0, *range(first, len(ids) + 1, 2048)]
        assert [got[i, k] for k in range(len(ends) - 1)] == [(a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(ends, ends[1:], strict=False)]


def test_plan_places_every_piece_without_gaps():
    rng = random.Random(1)
    for case in range(150):
        capacity = rng.choice([10, 20, 50, 2048])
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(0, 40))}
        runs, bins = packing.plan(counts, capacity), {}
        for size, n in counts.items():
            own = sorted(r for r in runs if r[0] == size)
            for rank in range(n):
                _, first, copies, at, offset = [r for r in own if r[1] <= rank][-1]
                bins.setdefault(at + (rank - first) // copies, []).append((offset + (rank - first) % copies * size, size))
        for b in bins.values():
            end = 0
            for offset, size in sorted(b):
                assert offset == end
                end += size
            assert end <= capacity
        least = max(-(-sum(k * v for k, v in counts.items()) // capacity), sum(v for k, v in counts.items() if 2 * k > capacity))
        assert len(bins) <= least * 1.25 + 2, case


def best_possible(sizes, capacity):
    """Fewest bins by trying all ways, for a handful of sizes."""
    best = [len(sizes)]

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(room)
            return
        for k in range(len(room)):
            if room[k] >= sizes[i] and room[k] not in room[:k]:
                go(i + 1, [*room[:k], room[k] - sizes[i], *room[k + 1 :]])
        go(i + 1, [*room, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_plan_is_nearly_optimal_on_small_cases():
    rng = random.Random(7)
    extra = 0
    for _ in range(120):
        sizes = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        runs = sorted(packing.plan(Counter(sizes), 20))
        bins = set()
        for size, n in Counter(sizes).items():
            own = [r for r in runs if r[0] == size]
            for rank in range(n):
                _, first, copies, at, _ = [r for r in own if r[1] <= rank][-1]
                bins.add(at + (rank - first) // copies)
        assert len(bins) >= best_possible(sizes, 20)
        extra += len(bins) - best_possible(sizes, 20)
    assert extra <= 6


def test_packing_round_trip(spark):
    texts = [*driver_texts()[:60], None, "", "word " * 9000, "same", "same"]
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(documents(spark, texts), RANKS, public_tokenizers.PATTERN).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = np.array([*encode(t or ""), 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert len(own) == -(-len(ids) // 2048) and all(r["length"] == 2048 for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for s in by_sequence.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-total // 2048) + 1


# ---- op6


def test_leaks_are_found_and_others_left_alone(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    say = lambda n: rng.choices(words, k=n)
    items = [(100 + i, say(rng.randint(14, 40))) for i in range(30)]
    texts, leaks = [], set()
    for d in range(400):
        own = say(rng.randint(5, 300))
        if d % 8 == 0:
            item, w = items[d // 8 % 30]
            w = [x.upper() if d % 16 == 0 else x for x in w]
            if d % 24 == 0:  # a paraphrase: one word in seven replaced
                w = [x if j % 7 else rng.choice(words) for j, x in enumerate(w)]
            at = rng.randint(0, len(own))
            own[at:at] = w
            leaks.add((d, item))
        texts.append(" ".join(own))
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in items), (900, None), (901, "")], "item_id long, text string")
    got = latent_decontamination.contaminated(documents(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == leaks
    kept = latent_decontamination.remove_contaminated(documents(spark, texts), bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(400)) - {d for d, _ in leaks}


def test_exact_benchmark_passages_of_the_driver_are_found(spark, duck):
    want = set(duck.sql("select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text)").fetchall())
    got = {(r["doc_id"], r["item_id"]) for r in queries.op6_latent_decontamination(spark, SF).collect()}
    assert want <= got and len(got) <= len(want) + 2


def test_items_of_any_length_are_found_also_next_to_each_other(spark):
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(f"item {k}", rng.choices(vocabulary, k=n)) for k, n in enumerate([6, 8, 12, 15, 15, 15, 20, 40, 90, 175, 250, 400, 1000])]
    prose = lambda n: rng.choices(vocabulary, k=n)  # noqa: E731 - the benchmark's own words
    texts, leaks = [], set()
    for k, (name, w) in enumerate(items):
        texts.append(prose(rng.randint(0, 300)) + w + prose(300))
        leaks.add((k, name))
    texts.append(prose(70) + items[3][1] + items[4][1] + items[5][1] + prose(70))
    leaks |= {(len(items), f"item {k}") for k in (3, 4, 5)}
    texts += [prose(500) for _ in range(60)]
    docs = documents(spark, [" ".join(w) for w in texts])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id string, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent_decontamination.contaminated(docs, bench).collect()}
    assert got == leaks


@pytest.mark.parametrize("others", [3000, 45])
def test_recall_of_verbatim_and_paraphrased_items(spark, others):
    """Items of 20 to 1000 words, verbatim and with one word in eight replaced; also in a small corpus."""
    rng = random.Random(37)
    vocabulary = [f"w{i}" for i in range(4000)]
    items = [(k, rng.choices(vocabulary, k=n)) for k, n in enumerate([20, 40, 60, 80, 100, 120, 140, 160, 180, 250, 500, 1000])]
    prose = lambda n: rng.choices(vocabulary, k=n)
    texts, leaks = [], set()
    for k, w in items:
        for told in (w, [x if rng.random() > 1 / 8 else rng.choice(vocabulary) for x in w]):
            leaks.add((len(texts), k))
            texts.append(prose(rng.randint(0, 200)) + told + prose(rng.randint(0, 200)))
    texts += [prose(rng.randint(5, 80)) for _ in range(others)]
    docs = documents(spark, [" ".join(w) for w in texts])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent_decontamination.contaminated(docs, bench).collect()}
    assert got <= leaks and len(got) >= 0.95 * len(leaks)


def test_recall_against_every_item_met_with_every_document(spark):
    """Recall over every hundredth document of the driver, against the longest common subsequence of all of them with all items."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 100 = 0 or text like '%the%'").limit(400)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in latent_decontamination.contaminated(docs, bench).collect()}
    items = [(r["item_id"], latent_decontamination.item_words(r["text"])) for r in bench.collect()]
    want = set()
    for d in docs.collect():
        w = latent_decontamination.item_words(d["text"])
        for k, own in items:
            for at in range(0, max(1, len(w)), len(own)):
                near = w[at : at + 3 * len(own)]
                if latent_decontamination.common_subsequence(own, near) >= 0.8 * len(own):
                    want.add((d["doc_id"], k))
    assert len(want & got) >= 0.9 * len(want) and len(got - want) <= 2


def test_repeated_rows_find_items_in_linear_time(spark):
    rng = random.Random(5)
    item = " ".join(f"w{rng.randint(0, 500)}" for _ in range(30))
    docs = spark.range(1500).select(F.lit(3).cast("long").alias("doc_id"), F.lit(f"before it {item} after it").alias("text"))
    got = latent_decontamination.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [(r["doc_id"], r["item_id"]) for r in got.collect()] == [(3, 1)] * 1500


def test_a_large_benchmark_is_met_in_parts_and_a_huge_one_refused(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, " ".join(f"w{rng.randint(0, 900)}" for _ in range(60))) for k in range(9)]
    docs = documents(spark, [t for _, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(latent_decontamination, "PIECES", 4)
    got = {(r["doc_id"], r["item_id"]) for r in latent_decontamination.contaminated(docs, bench).collect()}
    assert got == {(k, k) for k in range(9)}
    monkeypatch.setattr(latent_decontamination, "MOST_BYTES", 100)
    with pytest.raises(ValueError, match="bytes of text"):
        latent_decontamination.contaminated(docs, bench)


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(9)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(1, 20)) for _ in "12")
        assert latent_decontamination.common_subsequence(a, b) == plain(a, b)


# ---- op7


def brute_fingerprint(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = raw.split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_is_that_of_brute_force(spark):
    texts = [*driver_texts(), None, "", "One", "one TWO", "ÀB c d e", "x y z"]
    fps = [brute_fingerprint(t) for t in texts]
    want = union(len(texts), [(i, j) for i, j in combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2])
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == list(zip(fps, want, strict=True))


def test_chains_of_fingerprints_link(spark):
    rng = random.Random(4)
    values, at = [], rng.getrandbits(64)
    for _ in range(60):
        values.append(at)
        for k in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
            at ^= 1 << k
    values = list(dict.fromkeys(values))
    n = len(values)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for radius in (0, 2, 4):
        pairs = [(i, j) for i, j in combinations(range(n), 2) if (values[i] ^ values[j]).bit_count() <= radius]
        edges = simhash.links(fps, radius).collect()
        where = {v: i for i, v in enumerate(values)}
        got = [(where[r["a"] % (1 << 64)], where[r["b"] % (1 << 64)]) for r in edges]
        assert all((values[a] ^ values[b]).bit_count() <= radius for a, b in got)
        assert union(n, got) == union(n, pairs)


def test_stars_link_each_key_of_a_bucket_to_its_smallest(spark):
    rows = [(k, 1, 10) for k in (30, 10, 50)] + [(k, 2, 100) for k in range(100, 400)]
    got = [(r["a"], r["b"]) for r in simhash.stars(spark.createDataFrame(rows, "key long, bucket long, least long")).collect()]
    assert sorted(got) == sorted([(10, 30), (10, 50)] + [(100, k) for k in range(101, 400)])


def test_similar_links_all_pairs_from_a_jaccard_of_four_fifths_and_none_below(spark):
    rng = random.Random(21)
    words = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    texts, want = [], []
    for k in range(240):
        a, share = words(400), (0.75, 0.78, 0.8, 0.84)[k % 4]
        tail = 396 - math.ceil(792 * share / (1 + share)) if share >= 0.8 else 396 - math.floor(792 * share / (1 + share))
        texts += [" ".join(a), " ".join(a[: 400 - tail] + words(tail))]
        want += [2 * k, 2 * k if share >= 0.8 else 2 * k + 1]
    few = ["a b c d e f g h", "a b c d e f g h i", "a b c d e f x"]  # four shingles, five, three with two in common
    texts += few
    want += [480, 480, 482]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_crossings_name_all_similar_pairs_of_a_crowded_bucket(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    lows = rng.integers(0, 256, (1500, simhash.BANDS * simhash.ROWS), np.uint8)
    pairs = {(10, 1400), (11, 700), (300, 301)}
    for a, b in pairs:
        lows[b] = lows[a]
        lows[b, : simhash.BANDS * simhash.ROWS - simhash.ALIKE] += 1
    lows[1200] = lows[1201] = lows[3]
    keys = spark.createDataFrame([(k, x.tobytes(), 150 if k == 1200 else 100) for k, x in enumerate(lows)], "key long, low binary, size int")
    crowd = [(1, k, 3 if k == 1201 else k) for k in range(1500)] + [(2, k, 0) for k in range(1500)]
    got = simhash.crossings(spark.createDataFrame(crowd, "bucket long, key long, root long"), keys).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted(pairs)


def test_prefixes_let_all_similar_sets_meet_and_leave_out_those_with_a_passage_in_common(spark):
    rng = random.Random(12)
    some = lambda n: [rng.getrandbits(62) for _ in range(n)]
    passage, sets = some(60), []
    for k in range(300):  # sizes from 1 up, pairs about 0.8, frequent shingles in all
        own = some(rng.randint(1, 40)) + passage[: rng.choice((0, 30, 60))]
        sets += [own, own[rng.randint(0, len(own) // 5) :] + some(rng.randint(0, len(own) // 8))]
    rows = spark.createDataFrame([(k, sorted(set(x))) for k, x in enumerate(sets)], "key long, grams array<long>")
    met = {}
    for r in simhash.prefixes(rows).collect():
        met.setdefault(r["key"], set()).add(r["bucket"])
    for (i, x), (j, y) in combinations(enumerate(map(set, sets)), 2):
        if 9 * len(x & y) >= 4 * (len(x) + len(y)):
            assert met[i] & met[j], (i, j)

    n = 20_000  # of many sets with half in common, none is left; the time is linear in shingles
    many = spark.range(n).select(F.col("id").alias("key"), F.expr("concat(sequence(1L, 20L), transform(sequence(1, 20), k -> xxhash64(id, k)))").alias("grams"))
    assert simhash.prefixes(many).count() == 0
    near = many.union(many.where("key < 50").select(F.col("key") + n, F.expr("slice(grams, 1, 38)")))
    got = simhash.prefixes(near)
    assert got.select("key").distinct().count() == 100  # each shortened set and its origin
    assert got.groupBy("bucket").count().agg(F.max("count")).first()[0] == 2


def test_unsettled_keeps_one_of_several_buckets_with_the_same_keys(spark):
    rows = [(b, k, r) for b in (1, 2, 3) for k, r in ((10, 10), (11, 11), (12, 10))] + [(4, 10, 10), (4, 12, 10), (5, 10, 10), (5, 11, 11)]
    got = simhash.unsettled(spark.createDataFrame(rows, "bucket long, key long, root long")).collect()
    assert sorted((r["bucket"], r["key"]) for r in got) == [(1, 10), (1, 11), (1, 12), (5, 10), (5, 11)]


def test_a_bucket_of_unrelated_centres_loses_no_pair(spark):
    """Texts that share a long head, under 0.8, meet in many buckets; the pairs at 0.8 and more among them are all linked."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    head, texts = words(260), []
    for _ in range(150):
        own = head + words(140)
        texts += [" ".join(own), " ".join(own[:370] + words(30))]
    sets = [set(simhash.shingles(t).tolist()) for t in texts]
    want = union(len(texts), [(i, j) for i, j in combinations(range(len(texts)), 2) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) == 150


def test_the_driver_s_near_copies_are_those_of_brute_force(spark):
    texts = driver_texts()
    sets = [set(simhash.shingles(t).tolist()) for t in texts]
    want = union(len(texts), [(i, j) for i, j in combinations(range(len(texts)), 2) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_components(spark):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(50, 150), rng.randint(50, 150)) for _ in range(60)] + [(200, x) for x in range(201, 260)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(300, pairs)
    assert got == {x: want[x] for p in pairs for x in p if x in got} and set(got) == {x for a, b in pairs if a != b for x in (a, b)}


# ---- op8


def test_shards_hold_every_row_in_gapless_random_order(spark):
    rows = queries.op8_sharding(spark, SF).collect()
    want = {r[0]: r[1] for r in oracle.connect().sql("select doc_id, text from documents").fetchall()}
    assert sorted(r["doc_id"] for r in rows) == sorted(want)
    shards = {}
    for r in rows:
        raw = (want[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 8)
        shards.setdefault(r["shard"], []).append((r["slot"], r["doc_id"]))
    for own in shards.values():
        own.sort()
        assert [s for s, _ in own] == list(range(len(own)))
        assert len(own) < 5 or [d for _, d in own] != sorted(d for _, d in own)


def test_shards_are_those_of_plain_rendezvous_hashing(spark):
    """Spark's xxhash64 of a long and an int is XXH64 of the int's bytes, seeded by XXH64 of the long's bytes, seeded by 42."""
    import struct

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    ids = [*range(200), -5, 1 << 60]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = {r[0]: (r[1], r[2]) for r in df.select("doc_id", sharding.shard_of(F.col("doc_id"), 8), sharding.shard_of(F.col("doc_id"), 9)).collect()}
    for i in ids:
        own = xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
        weights = [(signed(xxhash.xxh64_intdigest(struct.pack("<i", s), own)), s) for s in range(9)]
        assert got[i] == (max(weights[:8])[1], max(weights)[1])
        assert got[i][1] in (got[i][0], 8)


def test_repeated_rows_are_spread_over_buckets(spark, tmp_path):
    row = "".join(random.Random(2).choices("abcdef ", k=900))
    docs = spark.range(4000, numPartitions=16).select(F.when(F.col("id") < 3900, F.lit(7)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.lit(row).alias("text"))
    docs = docs.union(documents(spark, [None, ""], [None, (1 << 53) + 1]).select("doc_id", "text"))
    written = sharding.slots(sharding.write_shards(docs, f"{tmp_path}/s", bucket_bytes=1 << 18)).collect()
    assert len(written) == 4002
    hot = Counter((r["shard"], r["bucket"]) for r in written if r["doc_id"] == 7)
    assert len(hot) > 4 and max(hot.values()) < 1300
    for s in {r["shard"] for r in written}:
        own = sorted(r["slot"] for r in written if r["shard"] == s)
        assert own == list(range(len(own)))


def test_shuffle_is_repeatable_and_depends_on_the_seed(spark):
    docs = documents(spark, [str(i) for i in range(200)])

    def order(seed, parts):
        out = sharding.slots(sharding.write_shards(docs.repartition(parts), sharding.shards_folder(docs), 3, seed, bucket_bytes=200))
        return [(r["shard"], r["slot"], r["doc_id"]) for r in out.orderBy("shard", "slot").collect()]

    assert order(1, 2) == order(1, 7) != order(2, 2)


# ---- op9


def test_quality_of_held_out_rows(spark, duck):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["river", "stone", "house", "light", "green", "walked", "under", "morning"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "$$$", "###", "click", "win!!"]) for _ in range(60))
    train = spark.createDataFrame([(f(), k) for k, f in ((1, good), (0, bad)) for _ in range(150)], "text string, label int")
    model = compression_quality.fit(train)
    y = np.array([1, 0] * 40)
    got = compression_quality.score(documents(spark, [good() if k else bad() for k in y]), model)
    s = np.array([r["score"] for r in got.orderBy("doc_id").collect()])
    assert ((s >= 0.7) == y).mean() > 0.95 and ((0 <= s) & (s <= 1)).all()


def test_too_few_labels_give_a_constant(spark):
    model = compression_quality.fit(spark.createDataFrame([("a", 1), ("b", 0), (None, 1), ("c", None)], "text string, label int"))
    assert {r["score"] for r in compression_quality.score(documents(spark, ["x", "", None]), model).collect()} == {0.5}


@pytest.mark.parametrize("name, modulus, held", [("op2_toxicity", 3, 1), ("op9_compression_quality", 4, 2)])
def test_scores_of_the_driver(spark, name, modulus, held):
    for r in queries.QUERIES[name](spark, SF).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_draw_takes_one_text_of_a_repeated_id(spark):
    docs = documents(spark, ["b text", "a text", "a text"] * 300, [1] * 900)
    known = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert [(r["text"], r["label"]) for r in labels.draw(docs, known, "toxic").collect()] == [("a text", 1)]


def test_the_queries_own_models_stand_odd_and_empty_tables(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("odd", [(1, "a b", None, None, None), (1, "a b", None, None, None), (2, "", None, None, None), (3, None, None, None, None), (None, "x", None, None, None)]), ("none", [])):
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1), (None, None, None)][: 4 * bool(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        for query in (queries.op2_toxicity, queries.op9_compression_quality):
            got = query(spark, f"{tmp_path}/{name}").collect()
            assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["held_out"] in (True, False) for r in got)


def test_draw_leaves_held_out_rows_and_is_bounded(spark):
    docs = documents(spark, [f"t{i}" for i in range(300)])
    own = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = labels.draw(docs, own, "toxic", ~labels.held_out(3, 1), most_per_class=20).collect()
    assert Counter(r["label"] for r in got) == {0: 20, 1: 20}
    assert all(zlib.crc32(r["text"][1:].encode()) % 3 != 1 for r in got)


# ---- op10


def test_only_ascii_letters_fold_and_whole_bodies_count(spark):
    body = license_scan.TEMPLATES[0][1].upper()
    texts = ["ALL Rights reserved", "All r\u0130ghts reserved", "this wor\u212a is licensed under the GNU General Public License version 3", body, " ".join(body.split()[:60]), "\u212a \u0130 x"]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(documents(spark, texts)).collect()}
    assert [got[i]["base_labels"] for i in range(6)] == ["reserved", "", "gpl", "", "", ""]
    assert got[3]["labels"] == "mit" and got[3]["score"] == 1.0 and got[5]["n_words"] == 3
    spans = {r["template"]: r["covered"] for r in license_scan.license_spans(documents(spark, [texts[2]])).collect()}
    grams = license_scan.TEMPLATES.index(("gpl", "this work is licensed under the gnu general public license version 3"))
    assert spans[grams] == pytest.approx(8 / 10)


def test_license_spans_survive_edits(spark):
    texts = [
        "x Released, under the MIT License. y",
        "Redistribution and use in source and binary forms, with or without any modification, are permitted provided the following conditions are met",
        "nothing of the kind",
        "All rights reserved. CC-BY 4.0 all rights reserved",
    ]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(documents(spark, texts)).collect()}
    assert (got[0]["labels"], got[0]["base_labels"], got[0]["score"]) == ("mit", "", 1.0)
    assert got[1]["labels"] == "bsd" and 0.5 <= got[1]["score"] < 1
    assert (got[2]["labels"], got[2]["n_base"], got[2]["first_word"], got[2]["score"]) == ("", 0, None, 0.0)
    assert (got[3]["base_labels"], got[3]["n_base"], got[3]["first_word"], got[3]["last_word"]) == ("cc-by,reserved", 3, 0, 7)


# ---- all of them on odd tables


def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names clash with the operators'."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    texts = [(1, "a b c d e"), (1, "a b c d e"), (2, ""), (3, None), (None, "null id here"), (None, None), (4, long), (5, long), (6, "\n\n"), (7, "a b c d e"), (8, "é x\x00y")]
    docs = spark.createDataFrame([(i, t, None if i == 2 else "en", None, None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: F.lit(0).cast("long") for c in ("ka", "kb", "fp", "score", "component_id", "shard", "bucket", "place", "length", "label", "first", "gone", "raw", "words", "x", "line", "size", "kept")}
    return docs.withColumns(extra)


def operators(spark):
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8"), (None, None)], "item_id long, text string")
    model = toxicity.train([("bad word", 1), ("fine", 0)] * 4)
    constant = compression_quality.CompressionModel(b"", b"", 0.0, 0.0)
    return {
        "op1": line_templates.drop_recurring_lines,
        "op2": lambda d: toxicity.score(d, model),
        "op3": lambda d: suffix_repeats.remove_repeats(d),
        "op4": perplexity.quality_rules,
        "op5": lambda d: packing.pack_documents(d, RANKS, public_tokenizers.PATTERN).where("piece = 0"),
        "op6": lambda d: latent_decontamination.contaminated(d, bench),
        "op7": simhash.near_duplicates,
        "op8": lambda d: sharding.slots(sharding.write_shards(d, sharding.shards_folder(d))),
        "op9": lambda d: compression_quality.score(d, constant),
        "op10": license_scan.scan_licenses,
    }


@pytest.mark.parametrize("name", [f"op{i}" for i in range(1, 11)])
def test_odd_rows(spark, name):
    docs = odd(spark)
    got = operators(spark)[name](docs).collect()
    if name == "op6":
        assert {r["doc_id"] for r in got} == {4, 5}
    else:
        assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", [f"op{i}" for i in range(1, 11)])
def test_empty_table(spark, name):
    assert operators(spark)[name](odd(spark).where("false")).collect() == []


def test_keep_one(spark):
    t = " ".join(f"word{i}" for i in range(400))
    docs = documents(spark, [t, t, t + " tail", "other text of its own here", None, None], [5, 3, 9, 1, 7, 8]).union(documents(spark, [t], [3]))
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 3, 7]


def test_keep_one_keeps_unlike_texts_of_one_id(spark):
    t = " ".join(f"word{i}" for i in range(400))
    docs = documents(spark, [t, "a text that is not like it", t + " tail", t, "null id", "null id"], [1, 1, 1, None, None, None])
    got = sorted((r["doc_id"] or 0, r["text"][:6]) for r in simhash.keep_one(docs).collect())
    assert got == [(0, "null i"), (1, "a text"), (1, "word0 ")]
