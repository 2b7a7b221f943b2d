"""Tests of this round's findings on the training-data operators."""

import random
import time

import numpy as np

from veritally.llm import latent_decontamination


def _runs(rng, longest, n):
    sizes = rng.integers(1, longest, n)
    return np.repeat(np.arange(n), sizes), np.cumsum(sizes) - sizes


def test_projection_sums_runs_of_any_length():
    rng = np.random.default_rng(4)
    weighted = rng.standard_normal((50, 7)).astype(np.float32)
    for longest, n in ((2, 5), (4, 300), (500, 20), (2000, 1)):
        rows, first = _runs(rng, longest, n)
        terms = rng.integers(0, 50, len(rows))
        there, y = latent_decontamination._project(terms, rows, weighted)
        ends = [*first[1:], len(rows)]
        assert there.tolist() == list(range(n)) and y.dtype == np.float32
        assert np.allclose(y, [weighted[terms[a:z]].sum(axis=0, dtype=np.float64) for a, z in zip(first, ends, strict=True)], rtol=1e-4, atol=1e-4)
    there, y = latent_decontamination._project(np.zeros(0, np.int64), np.zeros(0, np.int64), weighted)
    assert there.shape == (0,) and y.shape == (0, 7)


def test_projection_costs_a_few_passes_over_its_rows():
    """Column by column, short runs cost some 30 times what it takes to gather their rows."""
    rng = np.random.default_rng(5)
    weighted = rng.standard_normal((3000, 256)).astype(np.float32)
    rows, _ = _runs(rng, 6, 8000)
    terms = rng.integers(0, 3000, len(rows))

    def least(f):
        took = []
        for _ in range(5):
            begin = time.process_time()
            f()
            took.append(time.process_time() - begin)
        return min(took)

    assert least(lambda: latent_decontamination._project(terms, rows, weighted)) < 12 * least(lambda: weighted[terms])


def test_candidates_are_verified_without_the_texts(spark):
    """Texts are read once, for their word numbers; what is found in them is not met with them again."""
    rng = random.Random(8)
    item = " ".join(f"w{rng.randint(0, 500)}" for _ in range(30))
    docs = spark.createDataFrame([(k, f"x{k} before it {item if k % 3 else ''} after it") for k in range(60)] + [(None, item)], "doc_id long, text string")
    got = latent_decontamination.contaminated(docs, spark.createDataFrame([("a", item)], "item_id string, text string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "Aggregate" not in plan
    rows = {(r["doc_id"], r["item_id"], r["first_word"] <= 3, r["lcs"]) for r in got.collect()}
    assert rows == {(k, "a", True, 1.0) for k in range(60) if k % 3} | {(None, "a", True, 1.0)}
