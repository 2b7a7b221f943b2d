"""Quality classifier: compressed sizes under dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 2048
PRIOR_BYTES = 64
LEVEL = 3


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and the line that turns the size difference into a probability."""

    good: bytes
    bad: bytes
    slope: float
    offset: float

    def compressors(self) -> tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]:
        out = []
        for d in (self.good, self.bad):
            d = zstd.ZstdCompressionDict(d)
            d.precompute_compress(level=LEVEL)
            out.append(zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out[0], out[1]


def pieces(raw: bytes, size: int = PIECE) -> list[bytes]:
    """The whole text cut into pieces, so that a long text leans on the dictionary rather than on itself."""
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def difference(raw: bytes, good: zstd.ZstdCompressor, bad: zstd.ZstdCompressor) -> float:
    """(size under bad - size under good) / (their mean + PRIOR_BYTES): positive for text like the good; 0 for empty text.

    The constant draws short texts, of which sizes tell little, towards 0.
    """
    a = b = 0
    for p in pieces(raw):
        a += len(good.compress(p))
        b += len(bad.compress(p))
    return 2.0 * (b - a) / (a + b + 2 * PRIOR_BYTES)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 60) -> tuple[float, float]:
    """Logistic regression on one feature by Newton steps, with a small ridge; weights restore the classes' true shares."""
    weight = np.ones_like(x) if weight is None else weight / weight.mean()
    scale = float(np.std(x)) or 1.0
    z, w = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + 1e-2 * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, g), -5, 5)
    return float(w[0] / scale), float(w[1])


def fit(labelled: DataFrame, dictionary_bytes: int = 1 << 16, text_col: str = "text", label_col: str = "label") -> CompressionModel:
    """Dictionaries and calibration from a bounded sample of labelled rows, such as ``labels.draw`` returns.

    labelled may have a weight column: how many rows of its class a row stands for. Two thirds of each class build its dictionary (of their pieces the first
    100 * ``dictionary_bytes`` / 512, as the builder takes some hundred times a dictionary's size), the rest calibrates, so the line is fitted on texts that the
    dictionaries have not seen. Rows with null or empty text or null label are left out. With too few rows of a class
    for a dictionary, the model is constant at the share of good rows (0.5 without any rows).
    """
    weight = F.col("weight") if "weight" in labelled.columns else F.lit(1.0)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), weight.alias("weight"))
    drawn: dict[int, list[bytes]] = {0: [], 1: []}
    stands = {0: 1.0, 1: 1.0}
    for text, label, n in sorted((r[0].encode("utf-8", "surrogatepass"), r[1], r[2]) for r in rows.where("text <> '' and label in (0, 1)").toLocalIterator()):
        drawn[label].append(text)
        stands[label] = n
    for texts in drawn.values():
        np.random.Generator(np.random.PCG64(5)).shuffle(texts)
    good, bad = drawn[1], drawn[0]
    n_good, n_bad = len(good) * stands[1], len(bad) * stands[0]
    share = (n_good + 0.5) / (n_good + n_bad + 1) if good or bad else 0.5
    constant = CompressionModel(b"", b"", 0.0, float(np.log(share / (1 - share))))
    if min(len(good), len(bad)) < 30:
        return constant
    dictionaries = []
    for texts in (good, bad):
        parts = [p for t in texts[: 2 * len(texts) // 3] for p in pieces(t) if len(p) >= 16]
        try:
            dictionaries.append(zstd.train_dictionary(dictionary_bytes, parts[: 100 * dictionary_bytes // 512]).as_bytes())
        except zstd.ZstdError:
            return constant
    model = CompressionModel(dictionaries[0], dictionaries[1], 0.0, 0.0)
    c = model.compressors()
    rest = [(t, k) for k, texts in ((1, good), (0, bad)) for t in texts[2 * len(texts) // 3 :]]
    x = np.array([difference(t, *c) for t, _ in rest])
    slope, offset = calibrate(x, np.array([k for _, k in rest], float), np.array([stands[k] for _, k in rest]))
    return CompressionModel(dictionaries[0], dictionaries[1], slope, offset)


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the calibrated probability that a whole text is good, one row per input row.

    Null and empty texts have a size difference of 0 and so the model's base score. Other columns are ignored.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good_bad = model.compressors() if model.good else None
        for b in it:
            x = np.zeros(b.num_rows)
            if good_bad:
                for i, t in enumerate(b.column(1)):
                    x[i] = difference((t.as_py() or "").encode("utf-8", "surrogatepass"), *good_bad)
            s = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, f"doc_id {kind}, score double")
