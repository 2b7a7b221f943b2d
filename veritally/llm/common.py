"""Small helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN_FOLDERS:
        _OWN_FOLDERS[key] = f"file://{tempfile.mkdtemp(prefix='veritally-')}"
    return _OWN_FOLDERS[key]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table's folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001 - the session may have ended already
        pass


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the driver's process ends."""
    atexit.register(_remove_quietly, spark, path)


def hold(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors.

    The table goes when the driver's process ends; ``release`` removes it earlier.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._held_at = path
    remove_at_exit(spark, path)
    return out


def release(df: DataFrame) -> None:
    """Remove the table of a DataFrame that ``hold`` returned."""
    if path := getattr(df, "_held_at", None):
        remove(df.sparkSession, path)


def crc_text(col: str) -> Column:
    """crc32 of a column's decimal text, as the split of labelled rows uses it."""
    return F.crc32(F.col(col).cast("string"))


def wide(spark: SparkSession, least: int = 8) -> int:
    """Partitions for work that is spread by hand."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
