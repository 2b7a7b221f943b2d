"""Benchmark decontamination by latent semantic retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import hold

WINDOW, LEAST_WINDOW = 48, 6
RANK, EXTRA = 224, 32
COMMON, FEW, LEAST = 0.005, 50, 8
COSINE, LCS, SURE, RARE = 0.6, 0.55, 0.8, 0.5
#: Pieces of items that are met in one pass over the documents: at most 2048 * 48 terms, so 201 MB for a task's sums.
PIECES = 2048
#: Bytes of benchmark text that the driver takes.
MOST_BYTES = 64 << 20
_LETTERS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_BLOCK = 4096
#: Words of the texts that a task works on at a time; a longer text is taken alone.
_WORDS = 1 << 19
#: Weighted terms that are projected at a time.
_TERMS = 1 << 16
#: Members of a run whose rows are added together with those of other runs.
_LONG = 64


def item_words(text: str | None) -> list[bytes]:
    """Lower-case runs of letters and digits; what lies beyond ASCII counts as letters."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def width(words: int) -> int:
    """Words of the windows that a piece of so many words is looked for in: it fills over half of one, up to all of it."""
    w = LEAST_WINDOW
    while w < words:
        w *= 2
    return w


@dataclass(frozen=True)
class Items:
    """Some of the benchmark's items: a stated query set, held by the driver and every task.

    Items of over WINDOW words are looked for in pieces of equal length; of: each piece's item, begins: its first word there.
    """

    words: list[list[bytes]]
    vocabulary: dict[bytes, int]
    of: np.ndarray
    begins: np.ndarray
    widths: np.ndarray
    terms: np.ndarray
    pieces: np.ndarray

    @classmethod
    def cut(cls, words: list[list[bytes]]) -> Items:
        vocabulary = {x: k for k, x in enumerate(sorted({x for w in words for x in w}))}
        of, begins, widths, terms, pieces = [], [], [], [], []
        for k, w in enumerate(words):
            n = -(-len(w) // WINDOW)
            ends = [len(w) * i // n for i in range(n + 1)]
            for lo, hi in zip(ends, ends[1:], strict=False):
                pieces += [len(of)] * (hi - lo)
                terms += [vocabulary[x] for x in w[lo:hi]]
                of.append(k)
                begins.append(lo)
                widths.append(width(hi - lo))
        return cls(words, vocabulary, *(np.array(x, np.int64) for x in (of, begins, widths, terms, pieces)))


def _run_sums(table: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of ``index``, which begin at ``first``, the sum of the rows of ``table`` that it names.

    The k-th members of all runs are added at once, whole rows at a time; the few runs of over _LONG members are summed one by one.
    """
    sizes = np.diff(np.append(first, len(index)))
    by = np.argsort(-sizes, kind="stable")
    begin, sizes = first[by], sizes[by]
    many = int((sizes > _LONG).sum())
    sums = np.empty((len(first), table.shape[1]), table.dtype)
    for i in range(many):
        sums[i] = table[index[begin[i] : begin[i] + sizes[i]]].sum(axis=0, dtype=np.float64)
    sums[many:] = table[index[begin[many:]]]
    for k in range(1, int(sizes[many]) if many < len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k))  # so many have over k members
        sums[many:n] += table[index[begin[many:n] + k]]
    out = np.empty_like(sums)
    out[by] = sums
    return out


def _project(terms: np.ndarray, rows: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows present, the sums of their terms' rows of ``weighted``); rows come in order."""
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    return rows[first], _run_sums(weighted, terms, first)


def tokens(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, terms): the benchmark's number of every word of every whole text, -1 for words that no item has.

    Texts without a word of the benchmark are left out, as all their vectors are zero.
    """
    sent = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value

        def out(b: pa.RecordBatch, row: list[int], terms: list[np.ndarray]) -> pa.RecordBatch:
            ends, take = np.cumsum([0, *map(len, terms)]).astype(np.int32), pa.array(row, pa.int64())
            values = pa.array(np.concatenate(terms))
            return pa.RecordBatch.from_arrays([b.column(0).take(take), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "terms"])

        for b in it:
            row, terms, n = [], [], 0
            for i, t in enumerate(b.column(1)):
                own = item_words(t.as_py())
                ids = np.fromiter(map(known.get, own, repeat(-1)), np.int32, len(own))
                if len(ids) and ids.max() >= 0:
                    row.append(i)
                    terms.append(ids)
                    n += len(ids)
                if n >= _WORDS:
                    yield out(b, row, terms)
                    row, terms, n = [], [], 0
            if row:
                yield out(b, row, terms)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").where("text <> ''").mapInArrow(batches, f"doc_id {kind}, terms array<int>")


def _some(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of texts with _WORDS words or so."""
    ends = b.column(b.schema.get_field_index("terms")).offsets.to_numpy()
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _WORDS, side="right")) - 1)
        yield b.slice(lo, hi - lo)
        lo = hi


def _flat(b: pa.RecordBatch, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, document and place of each, words of each document) of a batch, for the terms that ``keep`` marks.

    keep has a last entry, false, for the words that no item has.
    """
    col = b.column(b.schema.get_field_index("terms"))
    sizes = np.diff(col.offsets.to_numpy()).astype(np.int64)
    terms = col.flatten().to_numpy()
    there = np.flatnonzero(keep[terms])
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[there]
    return terms[there], row, there - (np.cumsum(sizes) - sizes)[row], sizes


def _passages(b: pa.RecordBatch, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, passage of each) of a batch: texts are cut into passages of WINDOW words."""
    terms, row, place, sizes = _flat(b, keep)
    n = -(-sizes // WINDOW)
    return terms, (np.cumsum(n) - n)[row] + place // WINDOW


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _tree_sum(parts: DataFrame, fan: int = 256) -> np.ndarray:
    """Sum of float arrays (part, block, data): 256 tasks' arrays meet in a group, then their sums; the driver gets one each."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in group.column("data"))
        return pa.table({"part": [0], "block": [group.column("block")[0].as_py()], "data": [np.asarray(total).tobytes()]}, pa.schema([("part", pa.int64()), ("block", pa.int64()), ("data", pa.binary())]))

    shape = "part long, block long, data binary"
    once = parts.groupBy(F.floor(F.col("part") / fan).alias("some"), "block").applyInArrow(add, shape)
    rows = once.groupBy("block").applyInArrow(add, shape).orderBy("block").collect()
    return np.concatenate([np.frombuffer(bytes(r["data"]), np.float64) for r in rows]) if rows else np.zeros(0)


def _summed(held: DataFrame, size: int, of) -> np.ndarray:
    """Sum over all tasks of what ``of`` adds to a float array for each batch; in blocks of at most 8192 numbers."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, some = np.zeros(size), False
        for b in it:
            for x in _some(b):
                some = True
                of(x, total)
        if some:
            cuts = range(0, size, 8192)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(cuts), pa.int64()), pa.array(range(len(cuts)), pa.int64()), pa.array([total[a : a + 8192].tobytes() for a in cuts])],
                ["part", "block", "data"],
            )

    out = _tree_sum(held.mapInArrow(batches, "part long, block long, data binary"))
    return out if len(out) else np.zeros(size)


def latent_basis(held: DataFrame, items: Items, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(idf, basis): inverse document frequencies over all passages and the leading right singular vectors.

    Randomised SVD of the TF-IDF matrix A of all passages, in one pass over them: it sums Y = A'(A R) for a random R,
    from which the Nystroem form Y (R'Y)^-1 Y' of A'A gives singular vectors and values. The items' pieces are rows of A too,
    scaled so that they hold as much of its square sum as the corpus does: else the directions of an item that few
    passages hold would be lost. Terms in over COMMON of all passages (and in over FEW) carry no weight, as stop words, but for
    the LEAST rarest terms of each piece, so that every piece keeps some whatever the corpus is like.
    """
    v = len(items.vocabulary)

    every = np.arange(v + 1) < v

    def count(b: pa.RecordBatch, total: np.ndarray) -> None:
        terms, rows = _passages(b, every)
        total[:v] += np.bincount(_distinct(rows * v + terms) % v, minlength=v)
        total[v] += (np.diff(rows) > 0).sum() + (len(rows) > 0)

    df = _summed(held, v + 1, count)
    n, df = df[v], df[:v]
    keep = df <= max(COMMON * n, FEW)
    for k in range(len(items.of)):
        own = np.unique(items.terms[items.pieces == k])
        keep[own[np.argsort(df[own], kind="stable")[:LEAST]]] = True
    idf = np.where(keep, np.log((n + 1) / (df + 1)) + 1, 0.0)
    wide = min(RANK + EXTRA, v)
    start = np.random.Generator(np.random.PCG64(seed)).standard_normal((v, wide)).astype(np.float32)
    weighted = start * idf[:, None].astype(np.float32)
    some = np.append(idf > 0, False)

    def add(terms: np.ndarray, rows: np.ndarray, out: np.ndarray) -> float:
        """A'(A R) of these rows, added to out; returns their square sum."""
        if not len(terms):
            return 0.0
        there, y = _project(terms, rows, weighted)
        entry = np.searchsorted(there, rows)
        by = np.argsort(terms, kind="stable")
        which, begin = np.unique(terms[by], return_index=True)
        out[which] += _run_sums(y, entry[by], begin) * idf[which, None]
        return float((idf[terms] ** 2).sum())

    def power(b: pa.RecordBatch, total: np.ndarray) -> None:
        terms, rows = _passages(b, some)
        cuts = np.searchsorted(rows, rows[np.arange(0, len(terms), _TERMS)]) if len(terms) else []  # a passage is never cut
        ends = [*dict.fromkeys(cuts), len(terms)]
        for lo, hi in zip(ends, ends[1:], strict=False):
            total[-1] += add(terms[lo:hi], rows[lo:hi], total[:-1].reshape(v, wide))

    summed = _summed(held, v * wide + 1, power)
    own = np.zeros((v, wide))
    there = some[items.terms]
    square = add(items.terms[there], items.pieces[there], own)
    y = summed[:-1].reshape(v, wide) + own * (summed[-1] / max(square, 1e-9))
    small = start.T @ y
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    lead = values > values.max() * 1e-7
    left, size, _ = np.linalg.svd(y @ (vectors[:, lead] / np.sqrt(values[lead])), full_matrices=False)
    return idf, left[:, np.argsort(-size)[:RANK]].astype(np.float32)


def candidates(b: pa.RecordBatch, items: Items, wanted: np.ndarray, some: np.ndarray, weighted: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first word, piece, cosine) of the windows of a batch's whole texts that are near a piece of an item in the latent space.

    Each piece meets windows of its own width, which begin every half of it. Vectors are summed over blocks of words once,
    half as long as the narrowest windows; those of wider windows are sums of them. The benchmark is a stated query
    set, met in blocks of windows.
    """
    kinds = sorted(set(items.widths.tolist()))
    pieces = {w: np.flatnonzero(items.widths == w) for w in kinds}
    block = kinds[0] // 2
    most = kinds[-1] // block
    terms, row, place, sizes = _flat(b, some)
    blocks = -(-sizes // block) + most - 1  # empty ones behind each text, so that no window reaches into the next
    begin = np.cumsum(blocks) - blocks
    at = begin[row] + place // block
    total = int(blocks.sum())
    for lo in range(0, total if len(at) else 0, _BLOCK):
        hi = min(lo + _BLOCK + most - 1, total)
        a, z = np.searchsorted(at, [lo, hi])
        if a == z:
            continue
        there, y = _project(terms[a:z], at[a:z] - lo, weighted)
        sums, have = np.zeros((hi - lo, weighted.shape[1]), np.float32), 1
        sums[there] = y
        of = np.searchsorted(begin, np.arange(lo, min(lo + _BLOCK, hi)), side="right") - 1
        nth = np.arange(lo, lo + len(of)) - begin[of]
        for w in kinds:
            while have * block < w:
                sums = sums[:-have] + sums[have:]
                have *= 2
            n = min(len(sums), len(of))
            size = np.sqrt(np.einsum("ij,ij->i", sums[:n], sums[:n]))
            starts = (nth[:n] % (have // 2) == 0) & ((nth[:n] == 0) | (nth[:n] * block < sizes[of[:n]] - w // 2)) & (size > 1e-6)
            k = np.flatnonzero(starts)
            cos = (sums[k] @ wanted[pieces[w]].T) / size[k, None]
            i, j = np.nonzero(cos >= least)
            if len(i):
                yield of[k[i]], nth[k[i]] * block, pieces[w][j], cos[i, j]


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, in one pass over b with a bit for each word of a."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    ones = (1 << len(a)) - 1
    v = ones
    for x in b:
        if m := where.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & ones
    return len(a) - v.bit_count()


def found(held: DataFrame, items: Items, idf: np.ndarray, basis: np.ndarray, least: float = COSINE) -> DataFrame:
    """(doc_id, item, first_word, lcs, cosine): candidates whose words bear them out, the best of each document and item.

    They are verified where they are found, on the texts' word numbers: words that no item has never match one. lcs is the
    longest common subsequence's share of the whole item, within the place where the found piece puts it and a
    margin of up to WINDOW words. A passage stands if lcs is at least SURE, or at least LCS with the answer - the item's last
    quarter, where a question's answer stands - found to half or more, in each case with at least RARE of the item's
    uncommon words. item counts from 0.
    """
    weighted = basis * idf[:, None].astype(np.float32)
    own = idf[items.terms] > 0
    there, y = _project(items.terms[own], items.pieces[own], weighted)
    wanted = np.zeros((len(items.of), basis.shape[1]), np.float32)
    wanted[there] = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
    sent = held.sparkSession.sparkContext.broadcast((items, wanted, np.append(idf > 0, False), weighted))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, wanted, some, weighted = sent.value
        words = [[items.vocabulary[x] for x in w] for w in items.words]
        rare = [{x for x in w if some[x]} for w in words]
        for b in (x for whole in it for x in _some(whole)):
            ends, terms = b.column(1).offsets.to_numpy().astype(np.int64), b.column(1).flatten().to_numpy()
            ends -= ends[0]
            best: dict[tuple[int, int], tuple] = {}
            for hits in candidates(b, items, wanted, some, weighted, least):
                for i, at, piece, cosine in zip(*(x.tolist() for x in hits), strict=True):
                    k = int(items.of[piece])
                    own, begin = words[k], at - int(items.begins[piece])
                    margin = min(len(own), WINDOW)
                    lo, hi = max(0, begin - margin), begin + int(items.widths[piece]) + len(own) + margin
                    near = terms[ends[i] + lo : min(ends[i] + hi, ends[i + 1])].tolist()
                    if len(rare[k].intersection(near)) < RARE * len(rare[k]):
                        continue
                    share, here = common_subsequence(own, near) / len(own), set(near)
                    answer = own[-max(1, len(own) // 4) :]
                    told = sum(x in here for x in answer) * 2 >= len(answer)
                    if share >= SURE or share >= LCS and told:
                        best[i, k] = max(best.get((i, k), (0.0,)), (share, cosine, -max(begin, 0)))
            rows = [(i, k, -first, share, cosine) for (i, k), (share, cosine, first) in sorted(best.items())]
            cols = list(zip(*rows, strict=True)) or [[], [], [], [], []]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            take, *rest = (pa.array(c, k) for c, k in zip(cols, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), *rest], ["doc_id", "item", "first_word", "lcs", "cosine"])

    kind = held.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(batches, f"doc_id {kind}, item int, first_word int, lcs double, cosine double")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, lcs, cosine) for every document that holds a benchmark item or a paraphrase of it.

    Documents without one have no row. Null and empty texts and items hold nothing; repeated rows come back as often
    as they came; an empty benchmark gives no rows; item_id may be of any type. Items may have any length: those of over WINDOW
    words are found by their pieces and verified whole. Other columns are ignored. The benchmark is the list of queries, not
    data that grows with the corpus: over MOST_BYTES of its text raise an error, and more than PIECES pieces take a further
    pass over the documents.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text; it is sent to all tasks, so at most {MOST_BYTES} are taken")
    rows = [(r[0], w) for r in sorted(benchmark.select("item_id", "text").collect(), key=lambda r: (str(r[0]), r[1] or "")) if (w := item_words(r[1]))]
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
    out = spark.createDataFrame([], f"{kinds}, first_word int, lcs double, cosine double")
    parts, n = [[]], 0
    for r in rows:
        more = -(-len(r[1]) // WINDOW)
        if n and n + more > PIECES:
            parts.append([])
            n = 0
        parts[-1].append(r)
        n += more
    for part in filter(None, parts):
        items = Items.cut([w for _, w in part])
        held = hold(tokens(docs, items), "tokens")
        idf, basis = latent_basis(held, items)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(part)], f"item int, {kinds.split(', ', 1)[1]}")
        own = found(held, items, idf, basis).join(F.broadcast(names), "item").select(*out.columns)  # at most PIECES items
        out = own if len(parts) == 1 else out.unionByName(own)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that ``contaminated`` names; a null doc_id is matched like any other value."""
    lost = contaminated(docs, benchmark).select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost, docs["doc_id"].eqNullSafe(lost["_lost"]), "left_anti")
