"""A corpus pipeline of five stages: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
``run`` writes every stage's result as Parquet to the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import labels, latent_decontamination, line_templates, packing, simhash, toxicity
from veritally.llm.common import hold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the model is learned from labelled documents that may be learned from."""
    known = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(labels.draw(docs, known, "toxic", ~labels.held_out(3, 1), most_per_class=1200))
    others = [c for c in docs.columns if c != "doc_id"]
    scored = toxicity.score(docs, model, keep=tuple(others)).where(F.col("score") < toxicity.THRESHOLD)
    return scored.select("doc_id", *(F.col(f"_{c}").alias(c) for c in others)).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one that has lost every line goes, and n_chars follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    renamed = docs.select("doc_id", "text", *(F.col(c).alias(f"_{c}") for c in others))
    out = line_templates.drop_recurring_lines(renamed).where("not (n_dropped > 0 and trim(text) = '')")
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select("doc_id", "text", n_chars, *(F.col(f"_{c}").alias(c) for c in others)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, over shingles of five words."""
    return simhash.keep_one(docs, shingle=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item and no paraphrase of one."""
    return latent_decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, exact=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_copies),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack),
]

#: Toxicity, near-dedup, decontamination and packing are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the result is that of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = hold(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
