"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import (
    compression_quality,
    fill_in_middle,
    labels,
    latent_decontamination,
    license_scan,
    line_templates,
    packing,
    perplexity,
    sharding,
    simhash,
    source_divergence,
    spotsigs,
    suffix_repeats,
    toxicity,
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs across documents."""
    out = line_templates.drop_recurring_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", "text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels are learned from rows with crc32(doc_id) mod 3 other than 1."""
    docs = _read(spark, sf_dir, "documents")
    held = labels.held_out(3, 1)
    sample = labels.draw(docs, _read(spark, sf_dir, "labels"), "toxic", ~held, most_per_class=1200)
    scored = toxicity.score(docs, toxicity.fit(sample))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item or its paraphrase, with the item."""
    return latent_decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    near = simhash.near_duplicates(_read(spark, sf_dir, "documents"), radius=2, shingle=3)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels are learned from rows with crc32(doc_id) mod 4 other than 2."""
    docs = _read(spark, sf_dir, "documents")
    held = labels.held_out(4, 2)
    sample = labels.draw(docs, _read(spark, sf_dir, "labels"), "quality", ~held)
    scored = compression_quality.score(docs, compression_quality.fit(sample))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that strings of 400 bytes cover which also start elsewhere."""
    out = suffix_repeats.remove_repeats(_read(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the verdict of the perplexity band for every document."""
    out = perplexity.quality_rules(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenized by the byte-level vocabulary of 50k ids, packed into sequences of 2048."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the same vocabulary as byte_bpe_50k.json, as ranks
    packed = packing.pack_documents(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, exact=public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the key law, with the shard it has when there is one more."""
    docs = _read(spark, sf_dir, "documents")
    written = sharding.write_shards(docs, sharding.shards_folder(docs))
    digest = written.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).drop("text")
    return sharding.slots(digest).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", sharding.shard_of(F.col("doc_id"), 9).alias("grown_shard")
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license labels of every document."""
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of every document, with digests of its output and of the text rebuilt from that."""
    out = fill_in_middle.transform(_read(spark, sf_dir, "documents"))
    own = fill_in_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(own, 256).alias("restored_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of sources of a language with its divergence, and each group's most telling terms."""
    return source_divergence.audit(_read(spark, sf_dir, "documents"))


def op13_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are to it and to the next document's."""
    out = spotsigs.edited_likeness(_read(spark, sf_dir, "documents"))
    prints = [F.array_join(c, " ").alias(n) for c, n in (("signatures", "fingerprint"), ("edited_signatures", "edited_fingerprint"))]
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *prints, "near_edited", "near_next")


QUERIES = {
    "op1_line_templates": op1_line_templates,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_repeats": op3_suffix_repeats,
    "op4_perplexity_rules": op4_perplexity_rules,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_latent_decontamination": op6_latent_decontamination,
    "op7_simhash": op7_simhash,
    "op8_sharding": op8_sharding,
    "op9_compression_quality": op9_compression_quality,
    "op10_license_scan": op10_license_scan,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_source_divergence": op12_source_divergence,
    "op13_spotsigs": op13_spotsigs,
}

ORACLE_SQL = {
    "op1_line_templates": line_templates.ORACLE_SQL,
    "op10_license_scan": license_scan.ORACLE_SQL,
    "op11_fill_in_middle": fill_in_middle.ORACLE_SQL,
    "op12_source_divergence": source_divergence.ORACLE_SQL,
    "op13_spotsigs": spotsigs.ORACLE_SQL,
}
