"""Long matches anywhere in a corpus, by run-length indexes of content-dealt shards.

A window is a string of WINDOW bytes inside one document.  It is repeated when
the same string starts anywhere else; each byte that a repeated window covers is
removed.  One index of the whole corpus would be one task's work, so the corpus
is dealt by content:

* Each window belongs to the smallest hash of its GRAM-byte grams, its anchor;
  equal windows have equal anchors.  A piece is a run of neighbouring windows of
  one anchor (at most PIECE of them) with the bytes they cover.  Every window
  lies in exactly one piece.
* An anchor that a single piece has, with no second gram of its hash inside,
  repeats nothing.  A piece whose whole content occurs again is repeated whole.
  Both are told from hashes counted with map-side combine; copies of texts and
  common passages never meet as bytes.
* What is left are anchors with several contents.  A shard holds one piece of
  each content of some anchors.  Its index is the Burrows-Wheeler transform in
  runs, with a text position sampled at both ends of every run and the match
  length to the neighbour across the run's edge.  Inside a run a position's match
  is its left neighbour's less one byte, so the matching statistics of the shard
  stream along the text from the samples; windows with WINDOW or more are marked.
* An anchor whose contents exceed GROUP_BYTES isn't indexed in one task: its
  windows are counted by their whole content, again with map-side combine.

Marks meet the texts once more, by a hash of the text, so that copies of a text
are worked on once and rows need no identity of their own.

Edge cases: a null text is an empty one; texts under WINDOW bytes lose nothing;
repeated rows repeat each other; null and repeated doc_ids keep a row for each
input row; bytes, not characters, are cut, so kept bytes need not be UTF-8; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import mix
from .store import release, saved, table

WINDOW, GRAM = 400, 128
#: Windows of a piece at most; window starts of a text that are hashed at a time.
PIECE, SLICE = 4096, 1 << 20
#: Bytes of an index, and of the contents of one anchor that an index takes.
INDEX_BYTES, GROUP_BYTES = 1 << 21, 1 << 22

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_KEY = ["k1", "k2"]
_PLACES = "h long, c long, k1 long, k2 long, start long, windows int, again boolean"
_MARKS = "k1 long, k2 long, start long, stop long"


class _Rolling:
    """Hashes of all strings of one width in a byte array."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, width: int) -> np.ndarray:
        n = len(data)
        if len(self.up) < n:
            for name, by in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(n, by, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        return mix((sums[width:] - sums[:-width]) * self.down[: n - width + 1])


_ROLLING = tuple(map(_Rolling, _BASES))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of ``width`` neighbours: a suffix minimum of one block and a prefix minimum of the next."""
    n = len(x) - width + 1
    blocks = np.append(x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces(text: bytes, window: int, gram: int) -> Iterator[tuple[int, int, int, bool]]:
    """(anchor, first window, windows, whether a second gram of the anchor's hash lies inside) of a text, in order."""
    data, span = np.frombuffer(text, np.uint8), window - gram + 1
    for at in range(0, len(data) - window + 1, SLICE):
        grams = _ROLLING[0](data[at : at + SLICE + window - 1], gram)
        anchors = _least(grams, span)
        edges = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(anchors)]):
            for i in range(a, b, PIECE):
                j = min(i + PIECE, b)
                again = int(np.count_nonzero(grams[i : j + span - 1] == anchors[a])) > 1
                yield int(anchors[a].view(np.int64)), at + i, j - i, again


def _place_rows(window: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "bytes"))):
                for h, start, n, again in pieces(text, window, gram):
                    content = blake2b(text[start : start + n + window - 1], digest_size=8).digest()
                    found.append((h, int.from_bytes(content, "little", signed=True), k1, k2, start, n, again))
            yield _batch(found, _PLACES)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(v, types[k]) for v, k in zip(columns, kinds)], names)


class RunIndex:
    """The run-compressed transform of some strings, with samples at run ends.

    ``heads`` and ``lengths`` are the runs.  ``first`` and ``last`` are the text
    positions sampled at the two ends of each run, ``up`` and ``down`` their match
    lengths with the suffix before the run and after it.  Strings are joined by
    separators, each smaller than all bytes and different from all others.
    """

    #: Symbols of nine bits in the first sort key.
    WORD = 7

    def __init__(self, strings: list[bytes]) -> None:
        sizes = np.array([len(s) + 1 for s in strings])
        self.ends = np.cumsum(sizes)
        n = int(self.ends[-1])
        text = np.zeros(n + self.WORD, np.uint64)
        for s, end in zip(strings, self.ends.tolist()):
            text[end - len(s) - 1 : end - 1] = np.frombuffer(s, np.uint8)
            text[end - len(s) - 1 : end - 1] += np.uint64(1)
        left = np.repeat(self.ends, sizes) - 1 - np.arange(n)
        order, self.ranks = self._sorted(text, left, n)
        before = text[order - 1] if n else text[:0]
        before[order == 0] = 0
        edge = np.empty(n + 1, bool)
        edge[0] = edge[n] = True
        # Separators differ from each other, so each is a run.
        edge[1:n] = (before[1:] != before[:-1]) | (before[1:] == 0)
        starts, stops = np.flatnonzero(edge[:n]), np.flatnonzero(edge[1:])
        self.heads, self.lengths = before[starts].astype(np.int16) - 1, stops - starts + 1
        self.first, self.last = order[starts], order[stops]
        inner = self._match(text, self.last[:-1], self.first[1:])
        self.up, self.down = np.append(0, inner), np.append(inner, 0)
        self.size = n
        del self.ranks

    def _sorted(self, text: np.ndarray, left: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffixes in order, by doubling the compared length; ranks at each length."""
        word = np.zeros(n, np.uint64)
        for j in range(self.WORD):
            word = (word << np.uint64(9)) | text[j : n + j]
        short = left < self.WORD
        drop = (np.uint64(9) * (self.WORD - left[short]).astype(np.uint64)).astype(np.uint64)
        word[short] = word[short] >> drop << drop
        order = np.argsort(word, kind="stable")
        new = np.ones(n + 1, bool)
        new[1:n] = (word[order[1:]] != word[order[:-1]]) | short[order[1:]]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new[:n], np.arange(n), 0))
        ranks, width = [rank], self.WORD
        at = np.flatnonzero(~(new[:n] & new[1:]))
        while len(at):
            rows = order[at]
            key = (rank[rows].astype(np.int64) << 32) | rank[rows + width]
            by = np.argsort(key)
            # ``at`` lists the places of these rows in order, so sorted by old rank first they keep the same places.
            rows, key = rows[by], key[by]
            order[at] = rows
            new = np.ones(len(at) + 1, bool)
            new[1:-1] = key[1:] != key[:-1]
            rank = rank.copy()
            rank[rows] = np.maximum.accumulate(np.where(new[:-1], at, 0))
            ranks.append(rank)
            at = at[~(new[:-1] & new[1:])]
            width *= 2
        return order, ranks

    def _match(self, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes a and b, longest steps first."""
        a, b, start = a.copy(), b.copy(), a
        for level in range(len(self.ranks) - 1, -1, -1):
            same = self.ranks[level][a] == self.ranks[level][b]
            step = np.where(same, self.WORD << level, 0)
            a += step
            b += step
        on = np.ones(len(a), bool)
        for _ in range(self.WORD):
            on &= (text[a] == text[b]) & (text[a] > 0)
            a += on
            b += on
        return a - start

    def statistics(self) -> np.ndarray:
        """For each position the longest match that starts at any other one."""
        longest = np.zeros(self.size, np.int64)
        for at, match in ((self.first, self.up), (self.last, self.down)):
            reach = np.full(self.size, -1, np.int64)
            reach[at] = at
            value = np.zeros(self.size, np.int64)
            value[at] = match
            nearest = np.maximum.accumulate(reach)
            np.maximum(longest, value[nearest] - (np.arange(self.size) - nearest), out=longest)
        return longest


def _index_rows(window: int) -> Callable:
    """Marks of the pieces that occur once, from indexes of whole anchors."""

    def marks(held: list[tuple]) -> pa.RecordBatch:
        index, found = RunIndex([r[-1] for r in held]), []
        long = index.statistics() >= window
        for (k1, k2, start, single, content), end in zip(held, index.ends.tolist()):
            if single:
                first = end - 1 - len(content)
                on = np.diff(np.concatenate([[0], long[first : first + len(content) - window + 1].view(np.int8), [0]]))
                found += [(k1, k2, start + a, start + b) for a, b in zip(np.flatnonzero(on == 1).tolist(), np.flatnonzero(on == -1).tolist())]
        return _batch(found, _MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, anchor = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["h"] != anchor and size >= INDEX_BYTES:
                    yield marks(held)
                    held, size = [], 0
                anchor = row["h"]
                held.append((row["k1"], row["k2"], row["start"], row["copies"] == 1, row["bytes"]))
                size += len(row["bytes"])
        if held:
            yield marks(held)

    return run


def _window_rows(window: int) -> Callable:
    """A row for each window of a piece, with the hash of its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["bytes"], np.uint8)
                hashes = [pa.array(f(data, window).view(np.int64)) for f in _ROLLING]
                n = len(hashes[0])
                places = pa.array(np.arange(row["start"], row["start"] + n))
                same = [pa.array(np.full(n, row[k])) for k in ("h", "k1", "k2", "copies")]
                yield pa.RecordBatch.from_arrays([*hashes, same[0], *same[1:3], places, same[3]], ["w1", "w2", "h", "k1", "k2", "start", "copies"])

    return run


def _cut(window: int) -> Callable:
    """The pieces that are asked for, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                for p in row["wanted"]:
                    content = row["bytes"][p["start"] : p["start"] + p["windows"] + window - 1]
                    found.append((p["h"], row["k1"], row["k2"], p["start"], p["copies"], p["large"], content))
            yield _batch(found, "h long, k1 long, k2 long, start long, copies long, large boolean, bytes binary")

    return run


def _kept(window: int) -> Callable:
    """Counts and digests of texts without what their marks cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                text, kept, at, spans = row["bytes"], sha256(), 0, []
                for a, b in sorted((m["start"], m["stop"] + window - 1) for m in row["marks"]):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                for a, b in spans:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                found.append((row["k1"], row["k2"], sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            yield _batch(found, "k1 long, k2 long, removed long, spans long, sha string")

    return run


def repeated_windows(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(k1, k2, start, stop): runs of repeated windows in ``texts`` (k1, k2, bytes: a row per document; equal keys mean equal bytes)."""
    places = saved(texts.where(F.length("bytes") >= window).mapInArrow(_place_rows(window, gram), _PLACES), "pieces")
    live = places.groupBy("h").agg(F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("h")
    # Copies of a text have the same pieces: one row with their number.
    live = places.join(live, "h", "left_semi").groupBy("h", "c", *_KEY, "start", "windows").agg(F.count("*").alias("copies"), F.max("again").alias("again"))
    live = saved(live, "live")
    release(places)
    contents = live.groupBy("h", "c").agg(F.sum("copies").alias("copies"), F.max("again").alias("again"), F.min(F.struct(*_KEY, "start", "windows")).alias("at"))
    contents = saved(contents, "contents")
    whole = live.join(contents.where("copies > 1").select("h", "c"), ["h", "c"], "left_semi").select(*_KEY, "start", (F.col("start") + F.col("windows")).alias("stop"))

    groups = contents.groupBy("h").agg(F.count("*").alias("kinds"), F.sum(F.col("at.windows") + window - 1).alias("size"), F.max("again").alias("again"))
    groups = groups.where("kinds > 1 or again").select("h", (F.col("size") > group_bytes).alias("large"))
    wanted = contents.join(groups, "h").select("at.k1", "at.k2", F.struct("h", "at.start", "at.windows", "copies", "large").alias("p"))
    wanted = wanted.groupBy(*_KEY).agg(F.collect_list("p").alias("wanted"))
    # One copy of each text, combined before the shuffle.
    once = texts.groupBy(*_KEY).agg(F.first("bytes").alias("bytes"))
    cut = saved(once.join(wanted, _KEY).mapInArrow(_cut(window), "h long, k1 long, k2 long, start long, copies long, large boolean, bytes binary"), "cut")

    indexed = cut.where("not large").repartition("h").sortWithinPartitions("h").mapInArrow(_index_rows(window), _MARKS)
    windows = cut.where("large").mapInArrow(_window_rows(window), "w1 long, w2 long, h long, k1 long, k2 long, start long, copies long")
    often = windows.groupBy("w1", "w2", "h").agg(F.count("*").alias("n")).where("n > 1")
    counted = windows.where("copies = 1").join(often, ["w1", "w2", "h"], "left_semi").select(*_KEY, "start", (F.col("start") + 1).alias("stop"))
    return whole.unionByName(indexed).unionByName(counted)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.cast("binary").alias("bytes"))
    texts = rows.select(*_KEY, "bytes")
    marks = saved(repeated_windows(texts, window, gram, group_bytes), "marks")
    by_text = marks.groupBy(*_KEY).agg(F.collect_list(F.struct("start", "stop")).alias("marks"))
    once = texts.groupBy(*_KEY).agg(F.first("bytes").alias("bytes"))
    cut = saved(once.join(by_text, _KEY).mapInArrow(_kept(window), "k1 long, k2 long, removed long, spans long, sha string"), "kept")
    whole = rows.select("doc_id", *_KEY, F.length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("whole"))
    return whole.join(cut, _KEY, "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"),
    )


def op11_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
