"""Quality by compression: zstandard dictionaries of good and of bad text.

A text is compressed piece by piece under either dictionary.  The difference of
the two sizes over the larger one says which kind of text it is like; a
logistic curve fitted on labelled rows that the dictionaries have not seen
makes it a probability.

Edge cases: a null or empty text has difference 0; with labels of one kind only,
or none, every score is 0.5; repeated labels of a document count once, as 1 if
any says so; repeated rows of a document are learnt from side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .bytewords import texts_of
from .labelled import HELD_OUT, sample
from .store import table

#: Labelled rows are learnt from whole, in the order of a hash, up to so many rows and bytes; a row that would go beyond the bytes is passed over.
#: DICTIONARY_SHARE of the rows make the dictionaries, from all their bytes, the others the curve.
FIT_ROWS, FIT_BYTES, DICTIONARY_SHARE = 12_000, 1 << 23, 0.6
SAMPLE_BYTES = 2_048
DICTIONARY_BYTES, LEVEL, PIECE = 65_536, 1, 512
THRESHOLD = 0.7


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


class Differ:
    """(bad size - good size) / larger size of a whole text."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.good, self.bad = _compressor(good).compress, _compressor(bad).compress

    def __call__(self, text: bytes) -> float:
        good = bad = 0
        for i in range(0, len(text), PIECE):
            piece = text[i : i + PIECE]
            good += len(self.good(piece))
            bad += len(self.bad(piece))
        return (bad - good) / max(good, bad, 1)


def _samples(text: bytes) -> list[bytes]:
    """A whole text in pieces, as the dictionary's trainer takes them."""
    return [text[i : i + SAMPLE_BYTES] for i in range(0, len(text), SAMPLE_BYTES)]


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve by Newton steps, with a weak pull to 0."""
    a = np.stack([x, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (p - y) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels, size = [], [], 0
    for batch in batches:
        for t, label in zip(texts_of(batch.column("text")).cast(pa.large_binary()), batch.column("label").to_pylist()):
            text = t.as_py()
            if size + len(text) <= FIT_BYTES:
                size += len(text)
                texts.append(text)
                labels.append(label)
    cut = int(len(texts) * DICTIONARY_SHARE)
    kinds = [[s for t, v in zip(texts[:cut], labels[:cut]) if v == kind for s in _samples(t) if len(s) >= 8] for kind in (1, 0)]
    try:
        good, bad = (zstandard.train_dictionary(DICTIONARY_BYTES, k).as_bytes() for k in kinds)
    except (zstandard.ZstdError, ValueError):
        # Too few samples for a dictionary: their own bytes serve as one.
        good, bad = (b"".join(k)[:DICTIONARY_BYTES] for k in kinds)
    if not good or not bad:
        return
    differ = Differ(good, bad)
    x, y = np.array([differ(t) for t in texts[cut:]]), np.array(labels[cut:], dtype=float)
    slope, intercept = _curve(x, y)
    columns = [pa.array([v]) for v in (good, bad, slope, intercept)]
    yield pa.RecordBatch.from_arrays(columns, ["good", "bad", "slope", "intercept"])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes, float, float] | None:
    """Both dictionaries and the curve: two times DICTIONARY_BYTES and two numbers."""
    rows = sample(docs, labels, "quality", FIT_ROWS).mapInArrow(_fit, "good binary, bad binary, slope double, intercept double").collect()
    return (bytes(rows[0].good), bytes(rows[0].bad), rows[0].slope, rows[0].intercept) if rows else None


def _score(model: tuple[bytes, bytes, float, float] | None, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differ = Differ(model[0], model[1]) if model else lambda text: 0.0
        slope, intercept = model[2:] if model else (0.0, 0.0)
        for batch in batches:
            x = np.array([differ(t.as_py()) for t in texts_of(batch.column("text")).cast(pa.large_binary())])
            score = 1 / (1 + np.exp(-np.clip(slope * x + intercept, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, name])

    return run


def with_score(docs: DataFrame, model: tuple[bytes, bytes, float, float] | None, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores; a column of that name is replaced."""
    docs = docs.drop(name)
    return docs.mapInArrow(_score(model, name), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, quality)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = with_score(rows, fit(rows, labels))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", F.expr(f"int(score >= {THRESHOLD})").alias("predicted"))


def op10_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
