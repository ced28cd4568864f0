"""Quality rules: word counts, repetition, and bands of zstandard ratios.

Base rules count words, symbols, repeated lines and words in repeated 8-word
windows.  Every text is compressed whole and in chunks of CHUNK bytes: a ratio
above the limit for its length means repetition, one below means noise (random
letters, encodings), and a text goes as well when more than CHUNK_SHARE of its
chunks are beyond the limits for their lengths.  Prose compresses better the
longer it is, by 1.1 to 1.6 below 256 bytes and 2.3 to 2.8 beyond 16 KB, while
encoded bytes stay near 1.3, so both limits rise with the length.

Edge cases: a null text counts as an empty one, which has no words and fails the
base; ratios below 256 bytes are bounded loosely, since a frame's fixed bytes
weigh most there; a text of one chunk has no share of bad ones; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .bytewords import shingle_hashes, slices, texts_of, word_hashes, word_spans
from .store import table

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
LEVEL, CHUNK = 3, 1_024
#: (shorter than so many bytes, least ratio, largest ratio) of whole texts
BANDS = ((256, 0.3, 2.4), (1_024, 1.34, 2.5), (4_096, 1.45, 2.8), (16_384, 1.55, 3.3), (float("inf"), 1.6, 4.0))
#: The same for chunks, the last of which has half of CHUNK to one and a half of it.
CHUNK_BANDS, CHUNK_SHARE = ((768, 1.3, 2.4), (1_025, 1.42, 2.5), (float("inf"), 1.45, 2.6)), 0.25
_SPACES = b" \t\n\r\x0b\x0c"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_chunks double, kept boolean"


def repeated_words(words: np.ndarray) -> int:
    """Words in windows of WINDOW words that are found twice or more."""
    if len(words) <= WINDOW:
        return 0
    windows = shingle_hashes(words, WINDOW)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(words) + 1, dtype=np.int32)
    at = np.flatnonzero(twice)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def limits(bands: tuple, length: int) -> tuple[float, float]:
    return next(band[1:] for band in bands if length < band[0])


class Bands:
    """(ratio of the whole text, share of chunks beyond the limits, verdict)."""

    def __init__(self) -> None:
        self.size = lambda data, f=zstandard.ZstdCompressor(level=LEVEL).compress: len(f(data))

    def __call__(self, text: bytes) -> tuple[float, float, bool]:
        ratio = len(text) / self.size(text)
        least, most = limits(BANDS, len(text))
        # A last piece below half a chunk goes with the one before it.
        starts = range(0, max(1, len(text) - CHUNK // 2), CHUNK)
        ends = [*starts[1:], len(text)]
        bad = 0.0
        if len(starts) > 1:
            beyond = 0
            for s, e in zip(starts, ends):
                low, high = limits(CHUNK_BANDS, e - s)
                beyond += not low <= (e - s) / self.size(text[s:e]) <= high
            bad = beyond / len(starts)
        return ratio, bad, least <= ratio <= most and bad <= CHUNK_SHARE


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = Bands()
    for batch in batches:
        out = []
        for _, data, offs in slices(texts_of(batch.column("text"))):
            starts, ends, rows = word_spans(data, offs)
            words = word_hashes(data, starts, ends, lower=False)
            begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
            chars = np.concatenate([[0], np.cumsum(begins[ends] - begins[starts])])
            raw = data.tobytes()
            for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist())):
                text, n = raw[offs[i] : offs[i + 1]], b - a
                repeats = repeated_words(words[a:b])
                failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
                symbols = len(text) - len(text.translate(None, SYMBOLS))
                ratio, bad, kept = bands(text) if text else (0.0, 0.0, False)
                out.append((n, int(chars[b] - chars[a]), symbols, repeated_lines(text), repeats, failed, ratio, bad, kept and not failed))
        types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [c.split()[0] for c in SCHEMA.split(", ")])


def quality_rules(docs: DataFrame) -> DataFrame:
    """The counts, ratios and verdict for each row of ``docs`` (doc_id, text)."""
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(_rules, SCHEMA)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
