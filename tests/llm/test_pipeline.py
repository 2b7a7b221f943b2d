"""The pipeline's stages: columns, decisions, and the rows of run() against stages applied by hand."""

import pytest
from pyspark.sql import functions as F

from tests import oracle

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, oracle.SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        left = {r[0] for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) > 0.5 * len(ids), name
        ids = left
    got = pipeline.run(spark, oracle.SF).collect()
    assert {r["doc_id"] for r in got} == ids
    leaked = oracle.connect().sql("select doc_id from documents d join benchmark b on contains(d.text, b.text)").fetchall()
    assert not ids & {d for (d,) in leaked}


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_on_odd_tables(spark, tmp_path, rows):
    """Nulls in any column, repeated rows, empty texts and tables, and extra columns named like the operators' own."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    texts = [(1, "a b c. d e"), (1, "a b c. d e"), (2, ""), (3, None), (None, "null id here"), (None, None), (4, "\n\n"), (5, "x " * 9000)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts] if rows == "odd" else [], kinds)
    extra = ("_lost", "n_lines", "n_dropped", "row", "gone", "raw", "ka", "score", "key", "component_id", "label", "length", "piece", "sequence_id")
    docs = docs.withColumns({c: F.lit(c) for c in extra})
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)] if rows == "odd" else [], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "six words that stand for nothing"), (None, None)] if rows == "odd" else [], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert all(r[c] == c for r in docs.collect() for c in extra), name
    packed = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == ({1, 2, None, 5} if rows == "odd" else set())


def test_run_is_that_of_brute_force(spark):
    """run() over the driver's smallest documents against every stage done plainly: scores one by one, SQL lines, all pairs, all items."""
    from itertools import combinations

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from veritally.llm import labels, latent_decontamination, line_templates, simhash, toxicity

    duck = oracle.connect()
    docs = dict(duck.sql("select doc_id, text from documents").fetchall())
    known = spark.read.parquet(f"{oracle.SF}/labels.parquet")
    model = toxicity.fit(labels.draw(spark.read.parquet(f"{oracle.SF}/documents.parquet"), known, "toxic", ~labels.held_out(3, 1), most_per_class=1200))

    def plain_score(text):
        keep = 1 - (1 - np.exp(-model.leak))
        for a, b in toxicity.sentences(text):
            z = model.bias + sum(model.weights.get(w, 0.0) for w in toxicity.words(text[a:b]))
            keep *= 1 - 1 / (1 + np.exp(-z))
        return 1 - keep

    docs = {i: t for i, t in docs.items() if plain_score(t or "") < toxicity.THRESHOLD}

    duck.execute("create table own (doc_id bigint, text varchar)")
    duck.executemany("insert into own values (?, ?)", list(docs.items()))
    lines = duck.sql(line_templates.ORACLE_SQL.replace("from documents", "from own")).fetchall()
    docs = {i: t for i, _, n, t in lines if not (n and not t.strip(" "))}

    ids = sorted(docs)
    sets = {i: set(simhash.shingles(docs[i]).tolist()) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(ids, 2):
        if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    docs = {i: docs[i] for i in ids if find(i) == i}

    items = [latent_decontamination.item_words(t) for (t,) in duck.sql("select text from benchmark").fetchall()]

    def leaks(text):
        w = latent_decontamination.item_words(text)
        return any(
            latent_decontamination.common_subsequence(own, w[at : at + 3 * len(own)]) >= 0.8 * len(own) for own in items if own for at in range(0, max(1, len(w)), len(own))
        )

    docs = {i: t for i, t in docs.items() if not leaks(t)}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in docs.items()}
    got, places = {}, {}
    for r in pipeline.run(spark, oracle.SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
