"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import crc_text

MOST_PER_CLASS = 2000
MOST_BYTES = 1 << 16


def held_out(modulus: int, remainder: int, id_col: str = "doc_id") -> Column:
    """True where crc32 of the id's text has that remainder; false for a null id."""
    return F.coalesce(crc_text(id_col) % modulus == remainder, F.lit(False))


def draw(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column | None = None, most_per_class: int = MOST_PER_CLASS, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """(text, label, weight): at most ``most_per_class`` labelled documents of each of the classes 0 and 1.

    learn: a condition on labels, for rows that may be learned from. The ids with the smallest hashes are drawn from
    labels alone; as they are bounded, they are broadcast, and no text is shuffled. A text of over ``most_bytes`` is
    left out of the sample (of the sample only: scores read whole texts), so the sample fits the driver at any size.
    Rows with null id or label, and ids without a document, are left out; a repeated id counts once in the draw, and of
    several texts under one id the smallest is taken.
    weight is how many ids of its class a drawn id stands for; the quality classifier is calibrated by it, the toxicity model learns from the balanced
    sample as it is, so that its scores are those of two equally common classes.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if learn is not None:
        own = own.where(learn)
    own = own.groupBy("doc_id").agg(F.max(label).alias("label"))
    tops = [own.where(F.col("label") == k).orderBy(F.xxhash64(F.lit("draw"), "doc_id"), "doc_id").limit(most_per_class) for k in (0, 1)]
    sizes = own.groupBy("label").agg((F.count(F.lit(1)) / F.least(F.count(F.lit(1)), F.lit(most_per_class))).alias("weight"))
    ids = tops[0].unionByName(tops[1]).join(F.broadcast(sizes), "label")  # two rows
    small = docs.where(F.octet_length("text") <= most_bytes).select("doc_id", "text")
    found = small.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "label", "weight")).alias("x"))  # one text of each id
    return found.select("x.text", F.col("x.label").cast("int").alias("label"), "x.weight")
