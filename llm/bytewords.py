"""Vectorised word and shingle hashing over the UTF-8 bytes of Arrow string arrays.

A word is a maximal run of bytes other than space and \\t..\\r, so no Python
string is made for a text.  Every function works on slices of bounded size, so
memory does not depend on the batch size Spark happens to send.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything of ASCII that is neither letter nor digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint64) + _U(1)
_KEPT = _LOWER.copy()
_LOWER[65:91] += _U(32)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_POWERS = _Powers()


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array with null texts as empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows with about ``limit`` bytes; a longer text is a run of its own."""
    raw = texts.buffers()
    offs = np.frombuffer(raw[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1)
        yield row, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def word_spans(data: np.ndarray, offs: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = separators[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = True
    before[1:] = space
    after = before[1:].copy()
    after[:-1] = space[1:]
    after[-1] = True
    full = offs[:-1] < offs[1:]
    before[offs[:-1][full]] = True
    after[offs[1:][full] - 1] = True
    word = ~space
    starts, ends = np.flatnonzero(word & before[:-1]), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words, with A-Z lower-cased or as they are."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _POWERS.get(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER if lower else _KEPT)[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; one hash of the whole sequence when it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    h = np.full(n - width + 1, 0x2545F4914F6CDD1D * (width + 1) & (1 << 64) - 1, dtype=np.uint64)
    for j in range(width):
        h += words[j : n - width + 1 + j] * _U(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
    return mix(h)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text, in order."""
    for _, data, offs in slices(texts):
        starts, ends, rows = word_spans(data, offs)
        words = word_hashes(data, starts, ends)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            s = shingle_hashes(words[a:b], k)
            s.sort()
            if len(s) > 1:
                keep = np.empty(len(s), dtype=bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            yield s
