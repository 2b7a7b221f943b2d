"""How far the sources of a language differ in their words, by integer dictionaries and dense count vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritally.llm.common import hold, wide

LEAST_DOCUMENTS = 10
TOP = 10
SCALE = 10**9
CHUNK_CELLS = 1 << 19
HELD_TERMS = 1 << 18
MOST_GROUPS = 1 << 16
#: A-Z become a-z; every other ASCII byte that is no letter becomes a blank; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's documents, in parts of some HELD_TERMS terms, so memory is bounded."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            size = len(n)
            terms = pa.array(n.keys(), pa.binary())
            own = [pa.array([x] * size, pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays(
                [*own, terms.view(pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"]
            )
        counts.clear()

    held = 0
    for batch in batches:
        langs, sources, texts = batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary())
        for lang, source, text in zip(langs, sources, texts, strict=True):
            terms = Counter(text.as_py().translate(_FOLD).split(b" "))
            del terms[b""]
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(terms)
            docs.update(terms.keys())
            held += len(n) - before
            if held > HELD_TERMS:
                yield from flush()
                held = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and the number of the group's documents that hold it."""
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The counts of the terms that at least ``least`` documents of the language hold."""
    known = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    return counts.drop("docs").join(hold(known.select("lang", "term"), "dictionary"), ["lang", "term"])


def chunk_vectors(kept: DataFrame, width: int) -> DataFrame:
    """(lang, chunk, terms, source, counts): dense counts of a group over a run of ``width`` ids of the language's dictionary; one row of a chunk has its terms.

    Terms are put in order by range, so each partition's terms are a run of the language's sorted array; chunks number the runs. In a partition, the
    ids of a group's terms come from searchsorted in that array and its vector from bincount. Ids grow with the terms' UTF-8 bytes.
    """
    spread = kept.repartitionByRange(wide(kept.sparkSession), "lang", "term").sortWithinPartitions("lang", "term").withColumn("part", F.spark_partition_id())

    def vectors(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[tuple[bytes, str, int]] = []  # rows of the chunk that is being filled
        lang, part, serial, terms, last = None, 0, 0, 0, None

        def close() -> Iterator[pa.RecordBatch]:
            if not run:
                return
            rows = np.array([t for t, _, _ in run], object)
            own = np.unique(rows)  # bytes sort as UTF-8 does
            ids = np.searchsorted(own, rows)
            sources, which = np.unique(np.array([s for _, s, _ in run], object), return_inverse=True)
            n = np.array([n for _, _, n in run], np.int64)
            out = []
            for g in range(len(sources)):
                mine = which == g
                dense = np.zeros(len(own), np.int64)
                # bincount sums doubles, exact to 2^53; so the halves of a count are summed apart
                dense += np.bincount(ids[mine], n[mine] & 0xFFFFFFFF, len(own)).astype(np.int64)
                dense += np.bincount(ids[mine], n[mine] >> 32, len(own)).astype(np.int64) << 32
                out.append(dense)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(sources), pa.string()),
                    "chunk": pa.array([(part << 32) + serial] * len(sources), pa.int64()),
                    "terms": pa.array([list(own), *[[]] * (len(sources) - 1)], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                    "source": pa.array(list(sources), pa.string()),
                    "counts": pa.array([d.tolist() for d in out], pa.list_(pa.int64())),
                }
            )

        for batch in frames:
            for row_lang, term, source, n, row_part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row_lang != lang or (terms == width and term != last):
                    yield from close()
                    run, terms, last = [], 0, None
                    serial += 1
                if term != last:
                    terms += 1
                lang, part, last = row_lang, row_part, term
                run.append((term.encode(), source, n))
        yield from close()

    return spread.select("lang", "term", "source", "n", "part").mapInArrow(vectors, "lang string, chunk long, terms array<string>, source string, counts array<long>")


def smoothed(counts: np.ndarray, total: int, size: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * size)), exactly: in two steps of five and four digits where 64 bits hold them."""
    a, b = counts + 2, total + 2 * size
    if b < 1 << 46:
        first, rest = np.divmod(a * 10**5, b)
        return 1 + first * 10**4 + rest * 10**4 // b
    return np.array([1 + SCALE * int(x) // b for x in a], np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of smoothed shares, which are at most SCALE + 1."""
    return (p - q) * (p - q) // (p + q)


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, cells: int = CHUNK_CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each group differs from its language's other sources, and by which terms from the language.

    Part ``pair``: item is each other source of the language and value the divergence summed over all kept terms. Part ``term``: item is a
    term that the group uses more than its language does, of which the ``top`` most telling stay. Ranks go down by value; ties go by UTF-8.
    Nulls in text, lang and source are empty strings; every row is a document, repeated ones too; a group without terms, or a language
    without kept terms, has its pairs all the same (without kept terms: at 0); other columns of docs are ignored, whatever their names.

    The dictionary is spread by range over partitions, and a chunk holds at most ``cells`` / sources terms, so that the matrix of all sources over one
    chunk fits a task. The groups' totals have a row for each (lang, source), of which the result has the square; up to MOST_GROUPS of them are
    broadcast, beyond that they are joined.
    """
    spark = docs.sparkSession
    counts = hold(term_counts(docs), "counts")
    kept = hold(kept_terms(counts, least), "kept")
    sizes = kept.groupBy("lang").agg(F.countDistinct("term").alias("size"))
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = hold(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("size", F.lit(0)).alias("size")), "groups")
    most = groups.groupBy("lang").count().agg(F.max("count"), F.sum("count")).first()
    width = max(1, cells // max(1, most[0] or 1))
    small = F.broadcast if (most[1] or 0) <= MOST_GROUPS else lambda x: x
    totals = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("all"), F.max("size").alias("size"))
    chunks = chunk_vectors(kept, width).join(small(totals), "lang")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        lang, size = frame["lang"].iloc[0], int(frame["size"].iloc[0])
        sources = [x["source"] for x in frame["all"].iloc[0]]
        totals = [int(x["total"]) for x in frame["all"].iloc[0]]
        terms = list(max(frame["terms"], key=len))
        place = {s: i for i, s in enumerate(sources)}
        counts = np.zeros((len(sources), len(terms)), np.int64)
        for s, c in zip(frame["source"], frame["counts"], strict=True):
            counts[place[s]] = c
        p = np.array([smoothed(c, n, size) for c, n in zip(counts, totals, strict=True)])
        q = smoothed(counts.sum(axis=0), sum(totals), size)
        out = []
        for i, s in enumerate(sources):
            if i + 1 < len(sources):
                sums = divergence(p[i + 1 :], p[i]).sum(axis=1)
                out += [(lang, a, "pair", b, int(v)) for t, v in zip(sources[i + 1 :], sums, strict=True) for a, b in ((s, t), (t, s))]
            mine = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            value = divergence(p[i, mine], q[mine])
            first = np.argsort(-value, kind="stable")[:top]  # ids are in UTF-8 order, so a stable sort settles ties
            out += [(lang, s, "term", terms[mine[k]], int(value[k])) for k in first]
        return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])

    found = chunks.groupBy("lang", "chunk").applyInPandas(compare, "lang string, source string, part string, item string, value long")
    found = hold(found, "divergences")
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item")  # the rows of the result
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    both = pairs.unionByName(found.where("part = 'term'"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    out = both.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")


ORACLE_SQL = r"""
with docs as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
),
words as (select d, lang, source, unnest(w) as term from docs),
dictionary as (select lang, term from words group by all having count(distinct d) >= 10),
counts as (select lang, source, term, count(*)::hugeint as n from words join dictionary using (lang, term) group by all),
sizes as (select lang, count(*)::hugeint as v from dictionary group by all),
grps as (
  select lang, source, coalesce(v, 0) as v, coalesce((select sum(n) from counts c where c.lang = g.lang and c.source = g.source), 0)::hugeint as total
  from (select distinct lang, source from docs) g left join sizes using (lang)
),
grid as (
  select g.lang, g.source, t.term, coalesce(n, 0) as n, (1 + 1000000000::hugeint * (coalesce(n, 0) + 2) // (total + 2 * v))::hugeint as p
  from grps g join dictionary t using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = t.term
),
whole as (
  select lang, term, (1 + 1000000000::hugeint * (sum(n) + 2) // (any_value(total) + 2 * any_value(v)))::hugeint as q
  from counts join (select lang, sum(total) as total, any_value(v) as v from grps group by all) using (lang) group by lang, term
),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::bigint as value
  from grps a join grps b on a.lang = b.lang and a.source <> b.source
  left join grid x on x.lang = a.lang and x.source = a.source
  left join grid y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by all
),
term as (
  select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value
  from grid join whole using (lang, term) where n > 0 and p > q
),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from (select * from pair union all select * from term)
)
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 10
"""
