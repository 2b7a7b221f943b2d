"""Fill-in-the-middle transformation of documents by an index of their distinct texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from veritally.llm.common import hold

MARKERS = ("<P>", "<S>", "<M>")
SHARES = 1 << 11
BLOCK = 256  # bytes of the upper bits between two counts
HELD_BYTES = 32 << 20
INDEX = (
    StructType().add("n", "long").add("size", "long").add("low_bits", "integer").add("low", "binary").add("high", "binary").add("counts", "binary").add("marked", "boolean")
)
_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
_MARKS = tuple(m.encode() for m in MARKERS)


def elias_fano(text: bytes) -> tuple[int, int, int, bytes, bytes, bytes]:
    """(n, size, low_bits, low, high, counts): where the n code points of a UTF-8 text begin, and its end, as an Elias-Fano list.

    The n + 1 places are non-decreasing and at most ``size``. Each place gives its lower bits as they are and sets bit (place >> low_bits) + i of
    the upper bits. counts has the number of set bits before each block of BLOCK bytes, so that a place is found in one block.
    """
    raw = np.frombuffer(text, np.uint8)
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)).astype(np.int64)
    n = len(at) - 1
    bits = max(0, int(len(raw) // (n + 1)).bit_length() - 1)
    low = np.packbits((at[:, None] >> np.arange(bits) & 1).astype(np.uint8)).tobytes() if bits else b""
    marks = np.zeros(n + 1 + (len(raw) >> bits) + 1, np.uint8)
    marks[(at >> bits) + np.arange(n + 1)] = 1
    high = np.packbits(marks)
    padded = np.append(high, np.zeros(-len(high) % BLOCK, np.uint8)).reshape(-1, BLOCK)
    per_block = np.bitwise_count(padded).sum(axis=1, dtype=np.int64)
    return n, len(raw), bits, low, high.tobytes(), (np.cumsum(per_block) - per_block).tobytes()


def select(i: int, low_bits: int, low: bytes, high: bytes, counts: bytes) -> int:
    """The byte at which code point i begins (i = n: the text's end), read from one block of the upper bits."""
    before = np.frombuffer(counts, np.int64)
    block = int(np.searchsorted(before, i, "right")) - 1
    marks = np.unpackbits(np.frombuffer(high, np.uint8, min(BLOCK, len(high) - block * BLOCK), block * BLOCK))
    upper = block * BLOCK * 8 + int(np.flatnonzero(marks)[i - int(before[block])]) - i
    if not low_bits:
        return upper
    first, last = i * low_bits, (i + 1) * low_bits
    own = np.unpackbits(np.frombuffer(low, np.uint8, -(-last // 8) - first // 8, first // 8))[first % 8 :][:low_bits]
    return (upper << low_bits) | int((own.astype(np.int64) << np.arange(low_bits)).sum())


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, salt, text, INDEX): rows of (key, salt, text) with their boundary lists, but for texts whose bytes the task has seen lately.

    The task keeps at most HELD_BYTES of texts and one more, and gives out some 8 MB of them at a time.
    """
    seen: dict[tuple, bytes] = {}
    held = 0
    schema = pa.schema([("key", pa.binary()), ("salt", pa.int32()), ("text", pa.binary()), *zip(INDEX.names, _KINDS, strict=True)])
    rows: list[tuple] = []

    def given() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows.clear()
        # bytes of a valid text
        return out.set_column(2, "text", out.column(2).view(pa.string()))

    size = 0
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for i, (key, salt) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True)):
            text = texts[i].as_py()
            if seen.get((key, salt)) == text:
                continue
            if held > HELD_BYTES:
                seen, held = {}, 0
            seen[key, salt] = text
            held += len(text)
            rows.append((key, salt, text, *elias_fano(text), any(m in text for m in _MARKS)))
            size += len(text)
            if size > 8 << 20:
                yield given()
                size = 0
    if rows:
        yield given()


def text_index(docs: DataFrame, digest: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(index, members): one row of each distinct text with its Elias-Fano list, and the documents' ids with their index keys.

    index: key, salt, text and the columns of INDEX. members: doc_id, key, salt. Texts of one key (by default SHA-256) are compared as bytes while they
    are grouped, and two different ones stop the job, so a document that meets a key has that key's text exactly. A text that makes up more than
    1 / SHARES of all rows has an index row for each such share of its documents; there are fewer than SHARES such texts, which is the bound of
    their broadcast list. Copies in one task are dropped and lists made before texts move, and each text moves once.
    """
    key = F.unhex(F.sha2("text", 256)) if digest is None else digest
    keyed = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("key", key)
    ids = hold(keyed.select("doc_id", "key"), "keys")
    total = ids.count()
    common = ids.groupBy("key").count().where(F.col("count") * SHARES > total)
    common = F.broadcast(hold(common.select("key", F.ceil(F.col("count") * SHARES / F.lit(max(1, total))).cast("int").alias("salts")), "common"))
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("salts"))).cast("int").alias("salt")
    members = ids.join(common, "key", "left").select("doc_id", "key", salt)
    rows = keyed.join(common, "key", "left").select("key", salt, "text")
    rows = rows.mapInArrow(_once, StructType([StructField("key", BinaryType()), StructField("salt", IntegerType()), StructField("text", StringType()), *INDEX.fields]))
    # the smallest and the largest text of a key tell whether all are one; the exchange by key and salt serves the join too
    grouped = rows.repartition("key", "salt").groupBy("key", "salt").agg(F.min(F.struct("text", *INDEX.names)).alias("x"), F.max("text").alias("other"))
    same = F.when(F.col("x.text") == F.col("other"), F.col("x.text")).otherwise(F.raise_error(F.lit("two different texts have one digest")))
    return grouped.select("key", "salt", same.alias("text"), *(f"x.{c}" for c in INDEX.names)), members


def _draws(seed: int) -> list[Column]:
    """h1 to h4: the first four groups of eight digits of SHA-256 over seed, a colon and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


OUT = StructType().add("doc_id", "long").add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document.

    A text of n code points is cut twice, at places drawn from seed and id, both by ``select`` in its boundary list. psm is
    ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, spm is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle, plain is the text. Empty texts and those
    that hold a marker stay plain, as do ``plain_percent`` of the rest; then lengths are null. A null text is an empty one; a null id draws as
    an empty string; repeated rows come back as often as they are there and alike; other columns of docs are ignored, whatever their names.
    """
    index, members = text_index(docs.select("doc_id", "text"))
    drawn = members.select(F.col("doc_id").cast("long").alias("doc_id"), "key", "salt", *_draws(seed))
    joined = drawn.join(index, ["key", "salt"]).select("doc_id", "h1", "h2", "h3", "h4", "text", *INDEX.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "text"}
            texts = batch.column("text").cast(pa.binary())
            rows: list[list] = [[] for _ in range(6)]
            for i, n in enumerate(small["n"]):
                text = texts[i].as_py()
                row = (small["doc_id"][i], n, "plain", None, None, text)
                if n and not small["marked"][i] and small["h3"][i] % 100 < 100 - plain_percent:
                    a, b = sorted((small["h1"][i] % (n + 1), small["h2"][i] % (n + 1)))
                    p, m = (select(at, *(small[c][i] for c in ("low_bits", "low", "high", "counts"))) for at in (a, b))
                    prefix, middle, suffix = text[:p], text[p:m], text[m:]
                    if small["h4"][i] % 100 < spm_percent:
                        row = (small["doc_id"][i], n, "spm", a, b - a, b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle)
                    else:
                        row = (small["doc_id"][i], n, "psm", a, b - a, b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle)
                for column, value in zip(rows, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array(v, t) for v, t in zip(rows, kinds, strict=False)]
            # bytes of valid texts cut at code points are valid texts
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows[5], pa.binary()).view(pa.string())], OUT.names)

    return joined.mapInArrow(cut, OUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``transform`` was made of; no part of a cut text holds a marker, so the markers tell the parts."""
    part = F.split(output, "<[PSM]>", -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    out = F.when(form == "plain", output)
    for name, places in order.items():
        out = out.when(form == name, F.concat(*(F.get(part, F.lit(i)) for i in places)))
    return out


ORACLE_SQL = r"""
with drawn as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as d from documents
),
h as (
  select *, ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2, ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4 from drawn
),
cuts as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from h
),
outputs as (
  select *, case form when 'plain' then t
    when 'psm' then '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    else '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) end as o
  from cuts
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(o) as output_sha256, sha256(t) as restored_sha256
from outputs
"""
