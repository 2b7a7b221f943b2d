"""Repeated byte strings by a hash-compared suffix sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import hold, release

LENGTH = 400
GRAM = 64
HOT = 8192
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Any 256 numbers, for a second hash of bytes that shares nothing with the first.
_BYTES = np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 64, 256, np.uint64)
_PLACES = 24
_CHUNK = 4 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64; kept for the worker's next batch."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        held = _powers[base] = np.multiply.accumulate(x)
    return held[:n]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = hash of raw[i:j] times base^i, modulo 2^64."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(raw)), out=out[1:])
    return out


def window_hashes(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every window of ``length`` bytes."""
    out = []
    for base, symbols in ((_BASE, raw.astype(np.uint64) + np.uint64(1)), (_OTHER, _BYTES[raw])):
        s = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(symbols * powers(base, len(raw)), out=s[1:])
        out.append(_mix((s[length:] - s[:-length]) * powers(pow(base, -1, 1 << 64), len(raw) - length + 1)).view(np.int64))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors_of(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, anchor, first, last): each window of ``length`` bytes and the smallest gram hash in it.

    Windows from first to last share the anchor. It depends on the window's bytes only, so equal windows have equal
    anchors at the same place in them. Ties go to the leftmost gram.
    """
    n, parts = len(raw), []
    step = (1 << _PLACES) - length
    for at in range(0, max(n - length + 1, 0), step):
        own = raw[at : at + step + length - 1]
        s = prefix_hashes(own)
        h = _mix((s[gram:] - s[:-gram]) * powers(_INVERSE, len(s) - gram))
        m = (h >> np.uint64(_PLACES) << np.uint64(_PLACES)) | np.arange(len(h), dtype=np.uint64)
        wide, have = length - gram + 1, 1
        while have * 2 <= wide:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        if wide > have:
            m = np.minimum(m[: have - wide], m[wide - have :])
        place = (m & np.uint64((1 << _PLACES) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        parts.append((h[place[first]].view(np.int64), place[first] + at, first + at, last + at))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Suffixes:
    """Suffixes (forward) or reversed prefixes (backward) from places in one byte array, compared by hashes."""

    def __init__(self, raw: np.ndarray, hashes: np.ndarray, place: np.ndarray, room: np.ndarray, forward: bool):
        self.raw, self.hashes, self.place, self.room, self.forward = raw, hashes, place, room, forward
        self.power = powers(_BASE, len(raw) + 1)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extensions, by binary search over prefix hashes."""
        p, q = self.place[i], self.place[j]
        swap = p > q
        p, q = np.where(swap, q, p), np.where(swap, p, q)
        shift = self.power[q - p]
        lo, hi = np.zeros(len(p), np.int64), np.minimum(self.room[i], self.room[j])
        s = self.hashes
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            if self.forward:
                same = (s[p + mid] - s[p]) * shift == s[q + mid] - s[q]
            else:
                same = (s[p] - s[p - mid]) * shift == s[q] - s[q - mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def symbol(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The byte after ``at`` common ones, -1 at the end."""
        where = self.place[i] + at if self.forward else self.place[i] - at - 1
        return np.where(at < self.room[i], self.raw[np.clip(where, 0, len(self.raw) - 1)].astype(np.int16), -1)

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts strictly before suffix j."""
        n = self.common(i, j)
        return self.symbol(i, n) < self.symbol(j, n)

    def sort(self, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, lcp): a merge sort of each group of neighbours, all groups at once; lcp with the one before.

        Members of a group are begin ... begin + size - 1. Runs double in width; each element's place in the merged
        run is its own plus its rank in the sibling run, found by binary search with hash comparisons.
        """
        total = len(self.place)
        order, group = np.arange(total), np.repeat(np.arange(len(size)), size)
        start, end = begin[group], (begin + size)[group]
        width, most = 1, int(size.max()) if len(size) else 0
        while width < most:
            at = np.flatnonzero(end - start > width)
            run = (at - start[at]) // width
            left = run % 2 == 0
            other = np.where(left, start[at] + (run + 1) * width, start[at] + (run - 1) * width)
            stop = np.minimum(other + width, end[at])
            lo, hi = np.minimum(other, stop), stop
            base, mine = lo.copy(), order[at]
            while (open_ := lo < hi).any():
                k = np.flatnonzero(open_)
                mid = (lo[k] + hi[k]) // 2
                them = order[mid]
                # from the left run: how many are strictly less; from the right run: how many are not greater
                a = np.where(left[k], them, mine[k])
                b = np.where(left[k], mine[k], them)
                lt = self.less(a, b)
                before = np.where(left[k], lt, ~lt)
                lo[k], hi[k] = np.where(before, mid + 1, lo[k]), np.where(before, hi[k], mid)
            own = (at - start[at]) % width
            merged = start[at] + (run // 2) * 2 * width + own + (lo - base)
            new = order.copy()
            new[merged] = mine
            order = new
            width *= 2
        lcp = np.full(total, -1, np.int64)
        inner = np.flatnonzero(np.arange(total) != start)
        lcp[inner] = self.verified(order[inner - 1], order[inner], self.common(order[inner - 1], order[inner]))
        return order, lcp

    def verified(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n, cut at the first byte that differs: hashes that collide never count."""
        out = n.copy()
        for lo in range(0, len(n), 8192):
            size = n[lo : lo + 8192]
            end = np.cumsum(size)
            offset = np.arange(end[-1] if len(end) else 0) - np.repeat(end - size, size)
            sign = 1 if self.forward else -1
            p, q = (np.repeat(self.place[x[lo : lo + 8192]] - (not self.forward), size) + sign * offset for x in (i, j))
            wrong = np.flatnonzero(self.raw[p] != self.raw[q])
            if len(wrong):
                which = np.searchsorted(end, wrong, side="right")
                np.minimum.at(out, lo + which, offset[wrong])
        return out


def repeated_windows(raw: np.ndarray, place: np.ndarray, back: np.ndarray, ahead: np.ndarray, size: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """member x distance: whether the window that begins ``distance`` bytes before a member's anchor occurs twice.

    Members lie group by group (size: of each group) and share their anchor's gram; back and ahead are the bytes that
    belong to a member before and from its anchor. Two members share a window if they agree in ``distance`` bytes
    before and ``length - distance`` bytes from the anchor, so each distance has its classes from the common
    extensions of neighbours in the two suffix orders.
    """
    begin = np.cumsum(size) - size
    hashes = prefix_hashes(raw)
    classes = []
    for room, forward in ((ahead, True), (back, False)):
        classes.append(Suffixes(raw, hashes, place, np.minimum(room, length), forward).sort(begin, size))
    (order_f, lcp_f), (order_b, lcp_b) = classes
    most = int(back.max()) + 1 if len(back) else 0
    out = np.zeros((len(place), most), bool)
    nearest = length - ahead  # windows of a member begin from back down to this many bytes before its anchor
    f, b = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    for d in range(most):
        own = np.flatnonzero((nearest <= d) & (d <= back))
        if len(own) < 2:
            continue
        f[order_f] = np.cumsum(lcp_f < length - d)
        b[order_b] = np.cumsum(lcp_b < d)
        key = f[own] * (len(place) + 1) + b[own]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        out[own[by[1:][same]], d] = True
        out[own[by[:-1][same]], d] = True
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("ka"), F.xxhash64(F.lit(7), "text", "doc_id").alias("kb"), raw.alias("raw"))


def _anchors(keyed: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            row, cols = [], []
            for i, t in enumerate(b.column(2)):
                found = anchors_of(np.frombuffer(t.as_buffer(), np.uint8), length, gram) if len(t.as_buffer()) >= length else None
                if found:
                    row.append(np.full(len(found[0]), i))
                    cols.append(found)
            if cols:
                take = pa.array(np.concatenate(row))
                kh, a, lo, hi = (np.concatenate(x) for x in zip(*cols, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *map(pa.array, (kh, a, lo, hi))], ["ka", "kb", "kh", "a", "lo", "hi"])

    return keyed.select("ka", "kb", "raw").mapInArrow(batches, "ka long, kb long, kh long, a long, lo long, hi long")


def _segments(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes around each wanted anchor: its windows, from the first one's start to the last one's end."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            row, out, seg = [], [], []
            for i, (t, xs) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                raw = t.as_py()
                for x in xs.as_py():
                    row.append(i)
                    out.append((x["kh"], x["n"], x["a"] - x["lo"], x["lo"]))
                    seg.append(raw[x["lo"] : x["hi"] + length])
                    if len(row) >= 20_000:
                        yield pack(b, row, out, seg)
                        row, out, seg = [], [], []
            if row:
                yield pack(b, row, out, seg)

    def pack(b: pa.RecordBatch, row: list, out: list, seg: list) -> pa.RecordBatch:
        take, cols = pa.array(row, pa.int64()), np.array(out, np.int64).T
        return pa.RecordBatch.from_arrays(
            [b.column(0).take(take), b.column(1).take(take), *map(pa.array, cols), pa.array(seg, pa.binary())], ["ka", "kb", "kh", "n", "back", "lo", "seg"]
        )

    lists = wanted.groupBy("ka", "kb").agg(F.collect_set(F.struct("kh", "n", "a", "lo", "hi")).alias("xs"))  # within one document; repeated rows have the same
    joined = keyed.select("ka", "kb", "raw").join(lists.hint("shuffle_hash"), ["ka", "kb"])
    return joined.mapInArrow(batches, "ka long, kb long, kh long, n long, back long, lo long, seg binary")


def _sorted_groups(it: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by kh; whole groups are gathered to chunks of some MB and searched."""

    def search(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        segs = t.column("seg").to_pylist()
        raw = np.frombuffer(b"".join(segs), np.uint8)
        n = np.array([len(x) for x in segs], np.int64)
        back, lo, kh = (t.column(c).to_numpy() for c in ("back", "lo", "kh"))
        place = np.cumsum(n) - n + back
        size = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], kh[1:] != kh[:-1]])), [len(kh)]]))
        twice = repeated_windows(raw, place, back, n - back, size, length)
        edge = np.diff(np.pad(twice.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        anchor = lo[row] + back[row]
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [*(t.column(c).combine_chunks().take(take) for c in ("ka", "kb")), pa.array(anchor - end + 1), pa.array(anchor - begin + length)], ["ka", "kb", "s", "e"]
        )

    held: list[pa.RecordBatch] = []
    size = 0
    for b in it:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column(b.schema.get_field_index("seg")).nbytes
        if size >= _CHUNK:
            t = pa.Table.from_batches(held).combine_chunks()
            kh = t.column("kh").to_numpy()
            cut = int(np.searchsorted(kh, kh[-1]))  # the last group may go on
            if cut:
                yield search(t.slice(0, cut).to_batches())
                held = t.slice(cut).to_batches()
                size = sum(x.column(x.schema.get_field_index("seg")).nbytes for x in held)
    if held:
        yield search(held)


def equal_runs(own: bytes, other: bytes, shift: int, first: int, end: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(s, e) within first ... end of own: maximal stretches of ``length`` bytes or more that are equal to other's at s + shift."""
    x, y = np.frombuffer(own, np.uint8)[first:end], np.frombuffer(other, np.uint8)[first + shift : end + shift]
    edges = np.concatenate([[-1], np.flatnonzero(x != y), [len(x)]])
    return [(first + int(a) + 1, first + int(z)) for a, z in zip(edges, edges[1:], strict=False) if z - a - 1 >= length]


def _hot_windows(segments: DataFrame, length: int) -> DataFrame:
    """(ka, kb, s, e) for anchors that very many places share.

    Their windows are grouped by two independent 64-bit hashes. The smallest window of a group stands for it; each segment's
    windows are compared with it byte by byte, in runs, and only equal bytes count, so hashes that collide never do.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                w, v = window_hashes(np.frombuffer(b.column(1)[i].as_buffer(), np.uint8), length)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(w), i))), pa.array(np.arange(len(w))), pa.array(w), pa.array(v)], ["id", "at", "w", "v"])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cols: list[list] = [[], [], [], []]
            for r in b.to_pylist():
                for s, e in equal_runs(r["seg"], r["other"], r["shift"], r["first"], r["last"] + length, length):
                    for ka, kb, lo in ((r["ka"], r["kb"], r["lo"] + s), (r["ra"], r["rb"], r["rlo"] + s + r["shift"])):
                        for c, x in zip(cols, (ka, kb, lo, lo + e - s), strict=True):
                            c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["ka", "kb", "s", "e"])

    hot = hold(segments.withColumn("id", F.monotonically_increasing_id()).select("id", "ka", "kb", "lo", "seg"), "hot")
    windows = hold(hot.select("id", "seg").mapInArrow(batches, "id long, at long, w long, v long"), "windows")
    heads = windows.groupBy("w", "v").agg(F.min(F.struct("id", "at")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = windows.join(hold(heads.select("w", "v", "head"), "heads"), ["w", "v"]).where("id <> head.id or at <> head.at")
    runs = met.groupBy("id", F.col("head.id").alias("rid"), (F.col("head.at") - F.col("at")).alias("shift")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    runs = hold(runs, "runs")
    sides = runs.join(hot, "id").join(hot.select(F.col("id").alias("rid"), F.col("ka").alias("ra"), F.col("kb").alias("rb"), F.col("lo").alias("rlo"), F.col("seg").alias("other")), "rid")
    return sides.mapInArrow(compare, "ka long, kb long, s long, e long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(ka, kb, s, e): byte ranges of documents that strings of ``length`` bytes cover which also start elsewhere.

    Every window of ``length`` bytes has an anchor, its smallest gram hash. Anchors whose gram occurs once are dropped
    by a count over all documents; the bytes around the others are dealt out by gram. In each group the suffixes from
    the anchors and the reversed prefixes to them are merge-sorted; comparisons find the common extension by binary
    search over prefix polynomial hashes, and extensions of neighbours are checked byte by byte. Grams with over
    ``hot`` places, which could fill a task, have their windows grouped by Spark instead, and compared byte by byte with one of
    their group. Ranges may overlap.
    """
    keyed = _keyed(docs)
    anchors = hold(_anchors(keyed, length), "anchors")
    counted = anchors.groupBy("kh").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    grams = hold(counted, "grams")
    wanted = anchors.join(grams, "kh")  # tables on both sides: the join can split a gram with very many places
    segments = hold(_segments(keyed, wanted, length), "segments")
    release(anchors)
    release(grams)
    cool = segments.where(F.col("n") <= hot).repartition("kh").sortWithinPartitions("kh")
    found = cool.mapInArrow(lambda it: _sorted_groups(it, length), "ka long, kb long, s long, e long")
    return found.unionByName(_hot_windows(segments.where(F.col("n") > hot), length))


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, spans (array of s, e: maximal removed runs), kept (binary).

    A null text counts as empty; texts shorter than ``length`` keep everything. A repeated row is another document, so
    it and its twin lose all that is ``length`` bytes or longer. What is kept need not be valid UTF-8. Other columns
    are ignored.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            removed, spans, kept = [], [], []
            for t, xs in zip(b.column(1), b.column(2), strict=True):
                raw, own = t.as_py(), sorted((x["s"], x["e"]) for x in xs.as_py() or ())
                runs: list[list[int]] = []
                for s, e in own:
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([s, e])
                cuts = [0, *(x for r in runs for x in r), len(raw)]
                kept.append(b"".join(raw[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True)))
                removed.append(len(raw) - len(kept[-1]))
                spans.append([{"s": s, "e": e} for s, e in runs])
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            n = pa.array([len(t.as_buffer()) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    lists = repeated_spans(docs, length, hot).groupBy("ka", "kb").agg(F.collect_set(F.struct("s", "e")).alias("xs"))
    known = hold(lists, "spans")  # a table, so that the join can split the copies of one row
    joined = _keyed(docs).join(known.hint("shuffle_hash"), ["ka", "kb"], "left").select("doc_id", "raw", "xs")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(batches, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<s:long,e:long>>, kept binary")
