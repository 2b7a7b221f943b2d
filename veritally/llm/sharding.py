"""Shards in random order by a two-pass external shuffle."""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritally.llm.common import remove_at_exit, shared_folder

MOST_HEAVY = 1 << 20


def shard_of(key: Column, shards: int) -> Column:
    """Rendezvous hashing: the shard with the largest hash of (key, shard). A further shard takes rows only into itself."""
    weights = [F.struct(F.xxhash64(key, F.lit(s)).alias("w"), F.lit(s).alias("s")) for s in range(shards)]
    return F.greatest(*weights)["s"] if shards > 1 else F.lit(0)


def write_shards(
    docs: DataFrame, path: str, shards: int = 8, seed: int = 17, bucket_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write docs in shuffled order to ``path`` and return the written table.

    First pass: rows are scattered by seeded hashes of id and text into buckets of about ``bucket_bytes``, each within one
    shard; the number of buckets follows the shard's bytes. A row that is repeated so often that its copies would fill a
    bucket is dealt out by its place among the rows too; copies are alike, so it does not matter which of them lies where. At most
    MOST_HEAVY rows can have a 1 / MOST_HEAVY of all bytes each, which is the bound of their list. Second pass: each bucket is
    put in a fixed order, Fisher-Yates shuffled with its own seed, and written, so a task that runs again writes the same rows.
    Columns: doc_id, text, shard, bucket, place (within the bucket), size (UTF-8 bytes plus 1). A null text has no
    bytes and stays null. Repeated rows are all written. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        shard_of(F.col(id_col), shards).alias("shard"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
    )
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text"))
    total = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.sum("size").alias("n")).collect()}  # a row for each shard
    share = max(bucket_bytes / 4, sum(total.values()) / MOST_HEAVY)
    heavy = rows.groupBy("_h").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("k")).where((F.col("n") >= share) & (F.col("k") > 1)).select("_h", F.lit(1).alias("_heavy"))
    buckets = F.array(*(F.lit(max(1, math.ceil(total.get(s, 0) / bucket_bytes))) for s in range(shards)))
    draw = F.when(F.col("_heavy").isNull(), F.col("_h")).otherwise(F.xxhash64("_h", F.shiftright(F.monotonically_increasing_id(), 4)))
    spread = rows.join(F.broadcast(heavy), "_h", "left")  # at most MOST_HEAVY rows
    scattered = spread.withColumn("bucket", F.pmod(draw, F.get(buckets, F.col("shard"))).cast("int")).select(*rows.columns[:-1], "bucket")

    def shuffle(group: pa.Table) -> pa.Table:
        shard, bucket = group.column("shard")[0].as_py(), group.column("bucket")[0].as_py()
        crc = np.fromiter((zlib.crc32((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in group.column("text")), np.int64, group.num_rows)
        empty = group.column("text").is_null().to_pylist()
        ids = group.column("doc_id").to_pylist()  # a null id comes last
        keys = [((i is None, 0 if i is None else i), c, e) for i, c, e in zip(ids, crc.tolist(), empty, strict=True)]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        draw = np.random.Generator(np.random.PCG64([seed, shard, bucket]))
        draw.shuffle(order)  # Fisher-Yates
        out = group.take(pa.array(order))
        return out.append_column("place", pa.array(np.arange(len(order), dtype=np.int64)))

    kind = docs.schema[id_col].dataType.simpleString()
    done = scattered.groupBy("shard", "bucket").applyInArrow(
        shuffle, f"doc_id {kind}, text string, shard int, size long, bucket int, place long"
    )
    done.write.parquet(path)
    return spark.read.schema(done.schema).parquet(path)


def slots(written: DataFrame) -> DataFrame:
    """The written table plus slot: a row's place in its shard, gapless from 0 over the shard's buckets."""
    first = (
        written.groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_first", F.sum("_n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("_n"))
        .drop("_n")
    )
    return written.join(first, ["shard", "bucket"]).withColumn("slot", F.col("_first") + F.col("place")).drop("_first")


def shards_folder(docs: DataFrame) -> str:
    """A fresh folder for shards in the shared folder; it goes when the driver's process ends."""
    path = f"{shared_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    remove_at_exit(docs.sparkSession, path)
    return path
