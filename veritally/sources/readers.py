"""Readers of records, events, eligibility, id lists, corpora and source trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veritally import schemas
from veritally.functions.expressions import production_python


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row per task record; files being written (.partial) are left out, missing fields are null."""
    return spark.read.schema(schemas.RECORD).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)


def once(c: Column) -> Column:
    """c by an explode of one row, so that filters and columns over it do not each work it out again."""
    return F.explode(F.array(c))


def told_records(texts: DataFrame, value: str = "value") -> DataFrame:
    """texts plus ``record`` and ``broken``, which says what is wrong with a text that is no record and is null for the others; each text is parsed once.

    A text is broken that is no JSON object (cut off, a list, a bare value, empty) or has no instance_id.
    """
    bad = StructType.fromDDL(schemas.RECORD).add("_broken", "string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    parsed = texts.select("*", once(F.from_json(value, bad, options)).alias("record"))
    why = F.when(F.coalesce(value, F.lit("")).rlike(r"^\s*$"), "empty").when(F.col("record").isNull() | F.col("record._broken").isNotNull() | ~F.col(value).rlike(r"^\s*\{"), "no JSON object")
    return parsed.withColumn("broken", why.when(F.col("record.instance_id").isNull(), "no instance_id"))


def split_records(texts: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, broken): JSON texts as records, and the rows of those that are none, with ``broken`` as ``told_records`` has it.

    None of the broken becomes a row of nulls. Other columns of texts stay in both.
    """
    others = [c for c in texts.columns if c != value]
    told = told_records(texts, value)
    whole = told.where("broken is null").select(*others, *(f"record.{f.name}" for f in StructType.fromDDL(schemas.RECORD)))
    return whole, told.where("broken is not null").select(*others, value, "broken")


def checked_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, broken) of a folder of record files, each with its ``file``; a file that is cut off or empty is told in broken with its text."""
    texts = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/*.json")
    status = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(fs_path) or []
    # readers pass over files without bytes, so those are taken from the listing
    none = spark.createDataFrame([(s.getPath().toString(), "") for s in status if s.isFile() and s.getLen() == 0], "file string, value string")
    return split_records(texts.unionByName(none))


def eligible(spark: SparkSession, path: str) -> DataFrame:
    """Eligible tasks of a JSON-lines listing; a missing file is an error."""
    return spark.read.schema(schemas.ELIGIBLE).json(path).where("eligible")


def events(spark: SparkSession, path: str) -> DataFrame:
    """The append-only event log."""
    return spark.read.schema(schemas.EVENT).json(path)


def ids(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are neither blank nor begin with #."""
    return spark.read.text(path).select(F.trim("value").alias("instance_id")).where("instance_id <> '' and not startswith(instance_id, '#')")


def string_list(col: str | Column) -> Column:
    """A JSON-encoded list of strings as an array."""
    return F.from_json(col, "array<string>")


def corpus(spark: SparkSession, path: str, lists: tuple[str, ...] = ("FAIL_TO_PASS", "PASS_TO_PASS")) -> DataFrame:
    """Instances of a Parquet corpus; list columns that hold JSON text are decoded, arrays pass through."""
    df = spark.read.parquet(path)
    return df.withColumns({c: string_list(c) for c in lists if c in df.columns and dict(df.dtypes)[c] == "string"})


def source_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of production Python files below a folder; test, doc and hidden parts are left out."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").text(path, wholetext=True)
    inner = F.expr(f"substr(input_file_name(), instr(input_file_name(), '{path.rstrip('/')}') + {len(path.rstrip('/')) + 1})")
    return raw.select(inner.alias("path"), F.col("value").alias("text")).where(production_python(F.col("path")))


def witness_tasks(recs: DataFrame) -> DataFrame:
    """Ids of records with any witness."""
    return recs.where(F.exists("witnesses", lambda w: w["verdict"] == "WITNESS")).select("instance_id").orderBy("instance_id")


def complete(recs: DataFrame) -> DataFrame:
    """Records that say they are complete; null and false are not."""
    return recs.where("completed <=> true")


def verdict_rows(recs: DataFrame) -> DataFrame:
    """One row per verdict, with its record's keys and the control's outcome."""
    return recs.select(
        "instance_id", "repo", "multi_target", "n_targets", F.col("control.passed").alias("control_passed"), F.posexplode("rows").alias("ordinal", "r")
    ).select("instance_id", "repo", "multi_target", "n_targets", "control_passed", "ordinal", "r.*")
