"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"[^.!?\s][^.!?\n]*[.!?]*")  # in time linear in the text, long runs of white space included
_LETTERS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
THRESHOLD = 0.7


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence: from its first character that is not white space up to . ! ? or the line's end."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def words(sentence: str) -> set[bytes]:
    """The distinct words of a sentence, lower case, split at ASCII white space and punctuation, and their beginnings.

    Beginnings of 4 and 5 bytes, marked by a star, stand for inflected and compound forms.
    """
    whole = set(sentence.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    return whole | {w[:4] + b"*" for w in whole} | {w[:5] + b"*" for w in whole}


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of words, the bias of a sentence, and the rate at which documents are labelled without a cause."""

    weights: dict[bytes, float]
    bias: float
    leak: float

    def sentence_logits(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        known, w = self.weights.keys(), self.weights
        return np.array([self.bias + sum(w[x] for x in known & words(text[a:b])) for a, b in spans])

    def score(self, text: str) -> float:
        """Noisy-or of the sentences and the leak: 1 - (1 - leak) * product of (1 - p)."""
        z = self.sentence_logits(text, sentences(text))
        return float(-np.expm1(-self.leak - np.logaddexp(0, z).sum()))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", **how) -> ToxicityModel:
    """Train from document labels on a bounded sample of rows, such as ``labels.draw`` returns.

    The likelihood of a document is the noisy-or over its sentences; the gradient reaches the words of each sentence
    through it, so a toxic document's blame settles on the sentences that set it apart. Rows with null text or label are left out. Without both classes the score is the constant share of label 1.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).where("text is not null and label in (0, 1)")
    return train(sorted((r[0], r[1]) for r in rows.toLocalIterator()), **how)


def train(docs: list[tuple[str, int]], least_docs: int = 4, steps: int = 200, l1: float = 2e-4, bias: float = -8.0) -> ToxicityModel:
    """The model for (text, label) pairs by proximal AdaGrad steps on all of them.

    Words of fewer than ``least_docs`` documents have no weight; an L1 penalty (l1 for each document) keeps the others few.
    """
    y = np.array([k for _, k in docs], float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return ToxicityModel({}, -30.0, float(-np.log1p(-share)))
    known: dict[bytes, int] = {}
    entry, row, doc = array("i"), array("i"), array("i")
    for d, (text, _) in enumerate(docs):
        for a, b in sentences(text):
            own = sorted(words(text[a:b]))
            entry.extend(known.setdefault(x, len(known)) for x in own)
            row.extend([len(doc)] * len(own))
            doc.append(d)
    col, row, doc = (np.array(x, np.int64) for x in (entry, row, doc))
    df = np.bincount(np.unique(doc[row] * len(known) + col) % max(len(known), 1), minlength=len(known))
    place = np.cumsum(df >= least_docs) - 1
    keep = df[col] >= least_docs
    col, row = place[col[keep]], row[keep]
    vocab = [x for x, n in zip(known, df, strict=True) if n >= least_docs]
    del known, entry, df, place, keep
    w, leak_logit = np.zeros(len(vocab)), -6.0
    square, square_b, square_l, rate = np.full(len(vocab), 1e-3), 1e-3, 1e-3, 0.3
    for _ in range(steps):
        z = bias + np.bincount(row, w[col], len(doc))
        leak = np.log1p(np.exp(leak_logit))
        total = leak + np.bincount(doc, np.logaddexp(0, z), len(y))
        by_total = np.where(y == 1, -np.exp(-total) / np.maximum(-np.expm1(-total), 1e-6), 1.0)
        by_z = by_total[doc] / (1 + np.exp(-z))
        grad, grad_b, grad_l = np.bincount(col, by_z[row], len(vocab)), by_z.sum(), by_total.sum() / (1 + np.exp(-leak_logit))
        square += grad**2
        square_b += grad_b**2
        square_l += grad_l**2
        step = rate / np.sqrt(square)
        w -= step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1 * len(y), 0)
        bias -= rate * grad_b / np.sqrt(square_b)
        leak_logit -= rate * grad_l / np.sqrt(square_l)
    return ToxicityModel({vocab[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-3)}, float(bias), float(np.log1p(np.exp(leak_logit))))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, score, and the columns named in ``keep``; null and empty texts score the leak."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            s = np.fromiter((model.score(t.as_py() or "") for t in b.column(1)), float, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), *b.columns[2:]], ["doc_id", "score", *(f"_{c}" for c in keep)])

    kind = docs.schema[id_col].dataType.simpleString()
    also = "".join(f", `_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_{c}") for c in keep))
    return rows.mapInArrow(batches, f"doc_id {kind}, score double{also}")


def locate(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first, last, probability, sentence): offending sentences of documents that score at least ``threshold``.

    first and last are character offsets. Offending are the sentences at least as likely toxic as not, or else the
    document's likeliest one. A document whose score comes from the leak alone has none.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            row, out = [], []
            for i, t in enumerate(b.column(1)):
                text = t.as_py() or ""
                spans = sentences(text)
                if not spans or model.score(text) < threshold:
                    continue
                p = 1 / (1 + np.exp(-model.sentence_logits(text, spans)))
                for k in np.flatnonzero(p >= min(0.5, p.max())):
                    a, z = spans[k]
                    row.append(i)
                    out.append((a, z, float(p[k]), text[a:z]))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "first", "last", "probability", "sentence"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, f"doc_id {kind}, first long, last long, probability double, sentence string")
