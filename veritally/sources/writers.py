"""Sinks: Spark's commit protocol makes each of them appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sorted_json(df: DataFrame) -> DataFrame:
    """One JSON text per row with its keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines with sorted keys."""
    sorted_json(df).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str, by: str) -> None:
    """JSON lines in the order of a key."""
    df.orderBy(by).write.mode("overwrite").json(path)


def write_ids(df: DataFrame, path: str, header: tuple[str, ...]) -> None:
    """Comment lines, then one id per line; ids are ranges of a sort, the header is the first of them."""
    spark = df.sparkSession
    top = spark.createDataFrame([(0, i, f"# {h}") for i, h in enumerate(header)], "part int, n long, value string")
    body = df.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("n"), F.col("instance_id").alias("value"))
    top.unionByName(body).orderBy("part", "n", "value").select("value").write.mode("overwrite").text(path)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """JSON by folders, such as overlays by task."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def write_records(recs: DataFrame, path: str) -> None:
    """Task records as JSON lines with sorted keys, by repository; what a failed run wrote is never seen."""
    recs.select("repo", F.to_json(F.struct(*sorted(c for c in recs.columns if c != "repo"))).alias("value")).write.mode("overwrite").partitionBy("repo").text(path)


def append_rows(stream: DataFrame, path: str, checkpoint: str):
    """A checkpoint of finished rows: each micro-batch is appended once, and a restarted run goes on after it."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _parts(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The ledger: (kind, batch) of the folders of an upserted table."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted((n.split("-")[0], int(n.split("-")[1])) for n in names if n.startswith(("base-", "batch-")))


def write_batch(df: DataFrame, path: str, batch: int) -> bool:
    """Write one batch of an upserted table; False where the ledger says that a base holds it already.

    Each batch is a folder that is written whole, so the same batch written again, as after a failure, replaces itself and changes nothing.
    """
    if any(kind == "base" and upto >= batch for kind, upto in _parts(df.sparkSession, path)):
        return False
    df.write.mode("overwrite").parquet(f"{path}/batch-{batch}")
    return True


def latest(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """The last row of each key: of the latest batch, and of several in it the largest by ``order``. Nulls of a key are one key."""
    parts = _parts(spark, path)
    base = max((n for kind, n in parts if kind == "base"), default=None)
    live = [(kind, n) for kind, n in parts if (kind, n) == ("base", base) or kind == "batch" and (base is None or n > base)]
    if not live:
        raise ValueError(f"nothing has been written to {path}")
    rows = None
    for kind, n in live:
        own = spark.read.parquet(f"{path}/{kind}-{n}").withColumn("_batch", F.lit(n).cast("long"))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    cols = [c for c in rows.columns if c != "_batch"]
    top = rows.groupBy(key).agg(F.max(F.struct("_batch", order, *(c for c in cols if c not in (key, order)))).alias("x"))
    return top.select(*(F.col(key) if c == key else F.col(f"x.`{c}`").alias(c) for c in cols))


def compact(spark: SparkSession, path: str, key: str, order: str) -> None:
    """Write the last rows of all batches so far as one base, then remove what it holds.

    The base appears by one rename. Until then readers see the batches, afterwards the base, and a failure in between leaves one of the two.
    """
    parts = _parts(spark, path)
    batches = [n for kind, n in parts if kind == "batch"]
    if not batches:
        return
    upto = max(batches)
    fs, made = _folder(spark, f"{path}/_making-{upto}")
    latest(spark, path, key, order).write.mode("overwrite").parquet(f"{path}/_making-{upto}")
    if not fs.rename(made, _folder(spark, f"{path}/base-{upto}")[1]):
        raise OSError(f"{path}/base-{upto} is there already")
    for kind, n in parts:
        fs.delete(_folder(spark, f"{path}/{kind}-{n}")[1], True)


def upsert(stream: DataFrame, path: str, checkpoint: str):
    """Each micro-batch of a stream as a batch of an upserted table, for ``latest`` to read; the running query."""
    return stream.writeStream.foreachBatch(lambda batch, n: write_batch(batch, path, n)).option("checkpointLocation", checkpoint).start()
