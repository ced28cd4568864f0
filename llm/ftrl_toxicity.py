"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, lower-cased.  A text's features are the
distinct hashes of its words, word pairs and pairs with one word between, each
0 or 1.  Learning rates are per coordinate; the L1 term keeps all but a few
weights at zero, so the model is a short list that goes to every task.

Edge cases: a null or empty text has the bias as its only feature; without
labelled rows every score is 0.5; repeated labels of a document count once, as
1 if any says so; repeated rows of a document are learnt from side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import NOT_ALNUM, mix, slices, texts_of, word_hashes, word_spans
from .labelled import HELD_OUT, sample
from .store import table

BITS = 20
#: At most this many labelled rows are learnt from.
FIT_ROWS = 12_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 10.0, 0.2
THRESHOLD = 0.3
_U = np.uint64


def features(words: np.ndarray) -> np.ndarray:
    """Hashed 1-grams, 2-grams and 1-skip-2-grams of a sequence of word hashes, in buckets of 2 ** BITS."""
    pairs = mix(words[:-1] * _U(0x9FB21C651E98DF25) + words[1:])
    skips = mix(words[:-2] * _U(0xC2B2AE3D27D4EB4F) + words[2:] + _U(1))
    return (np.concatenate([words, pairs, skips]) >> _U(64 - BITS)).astype(np.int64)


def documents(texts: pa.Array) -> Iterator[np.ndarray]:
    """The features of every text in order, repeated ones included."""
    for _, data, offs in slices(texts):
        starts, ends, rows = word_spans(data, offs, NOT_ALNUM)
        words = word_hashes(data, starts, ends)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            yield features(words[a:b])


class Ftrl:
    """Weights of the coordinates seen; index 2 ** BITS is the bias, which has no L1 term."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0
        return w

    def bias(self) -> float:
        return float(-self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        for i, v in ((at, w), (-1, b)):
            grown = self.n[i] + g * g
            self.z[i] += g - (np.sqrt(grown) - np.sqrt(self.n[i])) / ALPHA * v
            self.n[i] = grown


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, labels, model = [], [], Ftrl()
    for batch in batches:
        rows += [np.unique(f).astype(np.uint32) for f in documents(texts_of(batch.column("text")))]
        labels += batch.column("label").to_pylist()
    for _ in range(EPOCHS):
        for at, label in zip(rows, labels):
            model.learn(at, label)
    w = model.weights(slice(0, 1 << BITS))
    at = np.flatnonzero(w)
    columns = [pa.array([x], t) for x, t in ((at.tolist(), pa.list_(pa.int64())), (w[at].tolist(), pa.list_(pa.float64())), (model.bias(), pa.float64()))]
    yield pa.RecordBatch.from_arrays(columns, ["at", "weight", "bias"])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the weights that are not zero, and the bias; at most 2 ** BITS numbers."""
    rows = sample(docs, labels, "toxic", FIT_ROWS).mapInArrow(_fit, "at array<long>, weight array<double>, bias double").collect()
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.array(rows[0].at, dtype=np.int64), np.array(rows[0].weight), rows[0].bias


def _score(at: np.ndarray, weight: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS, dtype=np.float64)
        dense[at] = weight
        for batch in batches:
            sums = []
            for f in documents(texts_of(batch.column("text"))):
                # Only features with a weight need to be told apart.
                sums.append(dense[np.unique(f[dense[f] != 0])].sum() + bias)
            score = 1 / (1 + np.exp(-np.clip(np.array(sums), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, toxic)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(_score(*fit(rows, labels)), "doc_id long, score double")
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", F.expr(f"int(score >= {THRESHOLD})").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
