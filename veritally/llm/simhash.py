"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritally.llm.common import hold
from veritally.llm.graph import components

SEED = 42
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the text's word shingles: a bit is set where over half the shingles' hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    parts = (np.fromiter((digest(g, SEED) for g, _ in zip(grams, range(min(_BLOCK, n - at)), strict=False)), np.uint64) for at in range(0, n, _BLOCK))
    return majority(parts, n)


def majority(parts: Iterable[np.ndarray], n: int) -> int:
    """64 bits, each set where over half of the n hashes have it; the hashes come in blocks."""
    seen = np.zeros(64, np.int64)
    for h in parts:
        seen += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(seen * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed 64-bit integer. Null and empty texts have 0."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, f"doc_id {kind}, fp long")


def ball(radius: int) -> list[int]:
    """Masks of at most ``radius`` of 64 bits, as signed integers."""
    masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints that keep all connections at ``radius`` or fewer differing bits.

    Each fingerprint emits every variant within half the radius; two of them within the radius share a variant. All
    fingerprints of a variant lie within the radius of each other, so each is linked to the variant's smallest: no
    pairs are listed. A variant has at most as many fingerprints as a ball has members (65 at radius 2), however
    many documents share a fingerprint.
    """
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("the radius has to be 0, 2 or 4: halves meet in the middle")
    masks = F.array(*[F.lit(m) for m in ball(radius // 2)])
    variants = fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))
    pairs = variants.withColumn("low", least).where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(
    docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (the smallest doc_id reachable over links, itself included).

    Rows with null or empty text share fingerprint 0 and are linked like any other. Repeated rows come back as often
    as they came. A null doc_id belongs to a component but never names one; a component of null ids only has null.
    Other columns of docs are ignored. Links, components and fingerprints stay distributed.
    """
    own = hold(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    by_fp = own.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(by_fp.select("fp"), radius))
    joined = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    joined = hold(joined, "roots")
    lows = hold(joined.groupBy("root").agg(F.min("low").alias("component_id")), "lows")  # tables on both sides, so that the join can split a large component
    classes = joined.join(lows, "root").select("fp", "component_id")
    return own.join(classes, "fp")


BANDS, ROWS = 24, 6
#: Of BANDS * ROWS MinHash values, cut to 8 bits: 116 are expected to agree at a Jaccard similarity of 0.8, with a deviation of
#: 4.8; pairs of a crowded bucket that agree in fewer than this are not verified by their shingles.
ALIKE = 90
#: Keys of one block of a crowded bucket.
_CROWD = 512
_ODD = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)))


def minima(base: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash values over the shingles' hashes."""
    low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(base), 1024):
        np.minimum(low, (base[at : at + 1024, None] * _ODD).min(axis=0), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """BANDS hashes of ROWS MinHash values each, as signed integers."""
    return np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(low.reshape(BANDS, ROWS))), np.uint64, BANDS).view(np.int64)


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, hash, key, size, fp, low, bands) of every row: hash stands for its text, key for its set of shingles, size for how
    many they are; fp is the SimHash over them, low their MinHash values cut to bytes."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            key, size, fp, low, many = [], [], [], [], []
            for t in b.column(1):
                own = shingles(t.as_py(), shingle)
                least = minima(own)
                key.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                size.append(len(own))
                fp.append(majority((own[at : at + _BLOCK] for at in range(0, len(own), _BLOCK)), len(own)))
                low.append((least >> np.uint64(32)).astype(np.uint8).tobytes())
                many.append(bands(least))
            ends = pa.array(np.arange(0, len(many) * BANDS + 1, BANDS, dtype=np.int32))
            signed = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (key, fp))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(many)))
            keys, prints = signed
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), keys, pa.array(size, pa.int32()), prints, pa.array(low, pa.binary()), lists],
                ["doc_id", "hash", "key", "size", "fp", "low", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, hash long, key long, size int, fp long, low binary, bands array<long>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(batches, shape)


def stars(crowd: DataFrame) -> DataFrame:
    """(a, b): each key of a bucket, b, with the bucket's smallest. crowd: (bucket, key, least)."""
    return crowd.where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))


def shingle_sets(docs: DataFrame, keys: DataFrame, wanted: DataFrame, shingle: int = 5) -> DataFrame:
    """(key, grams): the distinct shingle hashes of each wanted key, from one text that has it, as a held table.

    keys: (key, who) with who the doc_id and hash of that text; wanted: (key), distinct. No other texts are cut.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                sets = [shingles(t.as_py(), shingle).view(np.int64) for t in b.column(1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["key", "grams"])

    wanted = wanted.join(keys, "key").select("key", F.col("who.doc_id").alias("w"), F.col("who.hash").alias("h"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("w")) & (F.col("hash") == F.col("h"))).select("key", "text")
    return hold(texts.mapInArrow(batches, "key long, grams array<long>").dropDuplicates(["key"]), "shingles")


def prefixes(sets: DataFrame) -> DataFrame:
    """(bucket, key): shingles by which every two of the sets with a Jaccard similarity of 0.8 or more meet, for sets: (key, grams).

    Such a pair shares at least four fifths of either set, so with all shingles in one order each set has a common one among its
    first fifth. The order is from the rarest to the most frequent. Shingles of one set only are no common ones, so they are left out,
    and sets with less than four fifths left have no partner: that is what becomes of texts which share a passage and nothing else.
    """
    rows = sets.select("key", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    common = hold(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("of")).where("of > 1"), "common")  # a table, so that the join can split a frequent one
    own = rows.join(common, "gram").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("of", "gram"))).alias("grams"))
    spare = F.size("grams") - F.expr("cast((4 * n + 4) div 5 as int)")
    return own.where(spare >= 0).select("key", F.explode(F.slice("grams", F.lit(1), spare + 1)).alias("x")).select(F.col("x.gram").alias("bucket"), "key")


def unsettled(crowd: DataFrame) -> DataFrame:
    """The rows of crowd (bucket, key, root) in buckets with keys of several components; of buckets with the same keys, one stays.

    The same keys are told by their number, ends, and two independent 64-bit sums of hashes.
    """
    same = (
        F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"),
        F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"),
    )
    per = crowd.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most"), *same).where("least < most")
    one = per.groupBy("n", "low", "high", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    return crowd.join(hold(one, "unsettled"), "bucket")  # a table, so that the join can split a bucket


def crossings(crowd: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of a bucket's keys that are in different components and near enough to be verified.

    crowd: (bucket, key, root); keys: (key, low, size). A bucket whose keys are in one component has no pair left to
    tell. The others are dealt out in blocks of _CROWD keys or so, and each two blocks are compared on the MinHash values.
    """
    per = crowd.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("most"))
    blocks = F.ceil(F.col("n") / _CROWD).cast("int").alias("blocks")
    open_ = hold(per.where("least < most").select("bucket", blocks), "open")  # a table, so that the join can split a bucket
    left = crowd.join(open_, "bucket").join(keys.select("key", "low", "size"), "key")
    own = left.withColumn("block", F.expr("cast(pmod(xxhash64(key), blocks) as int)"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "root", "size", "low")

    def near(group: pa.Table) -> pa.Table:
        block, key, root, size = (group.column(c).to_numpy() for c in ("block", "key", "root", "size"))
        low = np.frombuffer(b"".join(group.column("low").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = []
        for at in range(0, len(one), _CROWD):
            x = one[at : at + _CROWD]
            for to in range(0, len(two), _CROWD):
                y = two[to : to + _CROWD]
                alike = np.zeros((len(x), len(y)), np.uint8)
                for t in range(BANDS * ROWS):
                    alike += low[x, t][:, None] == low[y, t][None, :]
                small, large = np.minimum(size[x][:, None], size[y][None, :]), np.maximum(size[x][:, None], size[y][None, :])
                fit = (alike >= ALIKE) & (5 * small >= 4 * large) & (root[x][:, None] != root[y][None, :])
                p, q = np.nonzero(fit & (key[x][:, None] < key[y][None, :]) if i == j else fit)
                found.append(np.stack([np.minimum(key[x[p]], key[y[q]]), np.maximum(key[x[p]], key[y[q]])]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(near, "a long, b long").distinct()


def verified(docs: DataFrame, keys: DataFrame, pairs: DataFrame, shingle: int = 5) -> DataFrame:
    """(a, b): the pairs of keys whose shingle sets have a Jaccard similarity of 0.8 or more.

    keys: (key, who, size) with who the doc_id and hash of one text. Sizes tell which pairs can reach it; only their texts are
    cut into shingles again.
    """
    for side, size in (("a", "m"), ("b", "n")):
        pairs = pairs.join(keys.select(F.col("key").alias(side), F.col("size").alias(size)), side)
    near = hold(pairs.where(5 * F.least("m", "n") >= 4 * F.greatest("m", "n")).select("a", "b", "m", "n"), "pairs")

    sets = shingle_sets(docs, keys, near.select(F.explode(F.array("a", "b")).alias("key")).distinct(), shingle)
    both = near.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("grams").alias("y")), "b")
    return hold(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.col("m") + F.col("n"))).select("a", "b"), "verified")


def _classes(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, hash, low_id, who): each row with its component's smallest doc_id, and with the doc_id and hash of the text that
    stands for the component."""
    own = hold(sketches(docs, shingle), "sketches")
    firsts = (F.first(c).alias(c) for c in ("size", "fp", "low", "bands"))
    who = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("who")
    keys = hold(own.groupBy("key").agg(F.min("doc_id").alias("low_id"), who, *firsts), "keys")

    # fingerprints within two bits meet in a variant; a variant has at most as many of them as a ball has members
    by_fp = hold(keys.groupBy("fp").agg(F.min("key").alias("key")), "prints")
    met = links(by_fp.select("fp"))
    for side in ("a", "b"):
        met = met.join(by_fp.select(F.col("fp").alias(side), F.col("key").alias(f"{side}_key")), side)
    met = met.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b"))

    rows = keys.select("key", F.explode(F.concat("bands", F.array("fp"))).alias("bucket"))
    several = hold(rows.groupBy("bucket").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    crowd = hold(rows.join(several, "bucket"), "crowd")  # tables on both sides, so that the join can split a bucket with very many keys
    linked = verified(docs, keys, stars(crowd).union(met).distinct(), shingle)
    roots = components(linked)
    rest = crowd.where("n > 2").join(roots.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("root"))
    rest = hold(unsettled(rest), "rest")
    own_roots = hold(rest.select("key", "root").distinct(), "settled")
    met = hold(prefixes(shingle_sets(docs, keys, own_roots.select("key"), shingle)).join(own_roots, "key"), "met")
    able = hold(unsettled(met).select("key").distinct(), "able")  # keys that may have a partner in another component
    more = hold(crossings(rest.join(able, "key"), keys), "crossings")
    if not more.isEmpty():
        roots = components(linked.union(verified(docs, keys, more, shingle)))
    joined = keys.select("key", "low_id", "who").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    joined = hold(joined, "roots")
    stands = hold(joined.groupBy("root").agg(F.min("low_id").alias("low_id"), F.min("who").alias("who")), "stands")  # as in near_duplicates
    named = joined.select("key", "root").join(stands, "root").select("key", "low_id", "who")
    return own.select("doc_id", "hash", "key").join(hold(named, "classes"), "key").drop("key")


def similar(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row per input row: doc_id, component_id, by links at a Jaccard similarity of 0.8 or more of word shingles.

    Documents meet in two ways. Each SimHash fingerprint emits all variants within one bit, and those that share a
    variant meet: these are the texts at two bits or fewer. At a similarity of 0.8 some 15 % of the bits differ, so
    fingerprints alone would miss nearly all such pairs; documents therefore also meet in any of BANDS bands of ROWS
    MinHash values, which a pair at 0.8 does with probability 0.9993. Keys of both are 64 bits, so chance meetings stay
    rare at any size. Of a bucket, each key is compared with the smallest. The keys of buckets that this leaves in several
    components are told by their rarest common shingles (``prefixes``, exact at 0.8) whether they may have a partner in another
    component, so a bucket of texts that share a passage only is done in time linear in their shingles; ``crossings``
    compares those of a bucket that may, and ``verified`` decides on the shingles. Null and empty texts are alike.
    """
    return _classes(docs, shingle).select("doc_id", F.col("low_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One document of each component of ``similar``, columns unchanged: the one with the smallest doc_id, a null one last.

    Of several texts under that doc_id, the one with the smallest hash stays; the others go, as they are near copies of it. Texts
    of one doc_id that are no near copies all stay. Rows alike in doc_id and text count as one document.
    """
    classes = hold(_classes(docs, shingle), "members")
    lost = classes.where(~(F.col("doc_id").eqNullSafe(F.col("who.doc_id")) & F.col("hash").eqNullSafe(F.col("who.hash")))).select(F.col("doc_id").alias("_w"), F.col("hash").alias("_h")).distinct()
    own = docs.withColumn("__text_hash", F.xxhash64("text"))
    kept = own.join(lost, own["doc_id"].eqNullSafe(lost["_w"]) & (own["__text_hash"] == lost["_h"]), "left_anti")
    if not classes.groupBy("doc_id", "hash").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "__text_hash"])
    return kept.select(*docs.columns)
