"""Best-fit packing of tokenized documents after Martello-Toth dominance reduction."""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritally.llm.common import hold, wide

CAPACITY = 2048
END = 0


#: Runs of white space from this length on are left to the tokenizers library: tiktoken's split backtracks over them and overflows.
_RUN = re.compile(r"\s{512}")


def encoder(path: str, pattern: str | None = None, exact: str | None = None) -> Callable[[str], list[int]]:
    """Text to ids, by the tokenizers library for a .json file, by tiktoken for a file of ranks.

    A tiktoken file needs the split pattern of its vocabulary. exact: the .json file of the same vocabulary, for the texts that
    tiktoken does not take: those with long runs of white space, and those that hold the string of an added token, which the
    library gives its own id.
    """
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: t.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if exact is None:
        return fast
    with open(exact, encoding="utf-8") as f:
        added = [x["content"] for x in json.load(f)["added_tokens"]]
    slow = functools.cache(lambda: encoder(exact))  # loaded for the first such text
    return lambda text: slow()(text) if _RUN.search(text) or any(x in text for x in added) else fast(text)


def token_pieces(
    docs: DataFrame, path: str, pattern: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", exact: str | None = None
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut where longer than capacity.

    The first piece takes the remainder, all later ones are full. Null and empty texts are the end id alone;
    texts of any length are taken whole, runs of white space of any length included.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern, exact)
        for b in it:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                ids = np.array([*encode(t.as_py() or ""), END], "<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(i)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(ids[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        batches, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Bins for a histogram of lengths: runs (length, first rank, copies to a bin, first bin, offset).

    The piece with rank r of a length lies in the run with the largest first rank <= r, in bin
    ``first bin + (r - first rank) // copies``, at ``offset + (r - first rank) % copies * length``.

    Reduction, largest length first: a piece that nothing fits beside is a bin; one with an exact partner, or beside
    which only one more piece can lie, or only two and the largest partner outweighs every pair, takes that partner.
    Each of these sets dominates all others with that piece, so fixing them loses nothing. What is left is packed by
    best fit in decreasing order. All steps act on whole classes of equal lengths, so the work and the result depend
    on the number of lengths, not of pieces: a bin holds at most 63 distinct lengths (1 + ... + 63 < 2048), at most
    two ranges of bins are begun for each length, and so there are under 4096 * 63 + 2048 runs.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        if not 0 < size <= capacity:
            raise ValueError(f"length {size} does not fit {capacity}")
        left[size] = n
    used, bins, runs = np.zeros_like(left), 0, []

    def place(size: int, copies: int, first_bin: int, offset: int, n: int) -> None:
        runs.append((size, int(used[size]), copies, first_bin, offset))
        used[size] += n
        left[size] -= n

    def best_pair(room: int, taken: int) -> int:
        """Largest sum within room of two pieces left besides one of length taken."""
        own = left.copy()
        own[taken] -= 1
        there = np.flatnonzero(own[: room + 1])
        if not len(there):
            return 0
        at = np.searchsorted(there, room - there, side="right") - 1
        same = at >= 0
        partner = np.where(same, there[np.maximum(at, 0)], 0)
        twice = (partner == there) & (own[there] < 2)
        at = np.where(twice, at - 1, at)
        ok = at >= 0
        return int((there[ok] + there[at[ok]]).max()) if ok.any() else 0

    for size in range(capacity, 0, -1):
        while left[size]:
            room = capacity - size
            small = np.flatnonzero(left)
            own = left.copy()
            own[size] -= 1
            fits = np.flatnonzero(own[: room + 1])
            if not len(fits):  # nothing lies beside it
                n = int(left[size]) if int(small[0]) > room else 1
                place(size, 1, bins, 0, n)
                bins += n
                continue
            partner = int(fits[-1])
            low = np.cumsum(np.repeat(fits[:3], np.minimum(own[fits[:3]], 3))[:3])  # of the one, two, three smallest
            two, three = (int(low[k]) if len(low) > k else capacity for k in (1, 2))
            if not (partner == room or two > room or three > room and partner >= best_pair(room, size)):
                break
            if partner == size:
                n = int(left[size]) // 2
                place(size, 2, bins, 0, 2 * n)
            else:
                n = int(min(left[size], left[partner]))
                place(size, 1, bins, 0, n)
                place(partner, 1, bins, size, n)
            bins += n

    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first bin, how many)
    for size in range(capacity, 0, -1):
        room = size
        while left[size]:
            while room <= capacity and not open_bins[room]:
                room += 1
            if room > capacity:  # new bins, as many copies in each as fit
                copies, n = capacity // size, int(left[size])
                whole, rest = divmod(n, copies)
                if whole:
                    place(size, copies, bins, 0, whole * copies)
                    open_bins[capacity - copies * size].append((bins, whole))
                    bins += whole
                if rest:
                    place(size, rest, bins, 0, rest)
                    open_bins[capacity - rest * size].append((bins, 1))
                    bins += 1
                break
            first, n = open_bins[room].pop()
            copies = room // size
            whole = min(n, int(left[size]) // copies)
            if whole:
                place(size, copies, first, capacity - room, whole * copies)
                open_bins[room - copies * size].append((first, whole))
            elif rest := int(left[size]):
                place(size, rest, first, capacity - room, rest)
                open_bins[room - rest * size].append((first, 1))
                whole = 1
            if n > whole:
                open_bins[room].append((first + whole, n - whole))
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with a length column, kept once in a table) plus sequence_id and offset, both longs.

    The driver sees the histogram of lengths only: at most ``capacity`` rows. Pieces are ranked within their length
    by salted windows, so that one length with a third of all pieces is spread over all partitions. Repeated pieces
    get places of their own; an empty input gives an empty result.
    """
    spark, salts = pieces.sparkSession, wide(pieces.sparkSession)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast((np.searchsorted(runs[:, 0], np.arange(capacity + 2)), runs))

    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    base = (
        salted.groupBy("length", "_salt")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
        .drop("_n")
    )
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order))
    ranked = salted.withColumn("_rank", number.cast("long") - 1).join(base, ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_base") + F.col("_rank")).alias("_rank"))
    names = pieces.columns

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, table = sent.value
        for b in it:
            size, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.empty(len(size), np.int64)
            for s in np.unique(size):
                lo, hi = begins[s], begins[s + 1]
                mine = size == s
                at[mine] = lo + np.searchsorted(table[lo:hi, 1], rank[mine], side="right") - 1
            _, first, copies, first_bin, offset = table[at].T if len(at) else np.zeros((5, 0), np.int64)
            which, nth = (rank - first) // np.maximum(copies, 1), (rank - first) % np.maximum(copies, 1)
            cols = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(first_bin + which), pa.array(offset + nth * size)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(places, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, pattern: str | None = None, capacity: int = CAPACITY, exact: str | None = None) -> DataFrame:
    """All documents packed: one row per piece with doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(hold(token_pieces(docs, path, pattern, capacity, exact=exact), "pieces"), capacity)
