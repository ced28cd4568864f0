"""Benchmark decontamination by templates, as a hash join of windows.

Texts become sequences of tokens: lower-cased words, and typed slots for numbers
(digits or number words), for units after a number ("4 kg" as well as "4kg"), and
for names (capitalised words that are no common function words; words in a row are
one name).  A second sequence has the names as plain words, so that a copy in
other case is the same there.  Windows of WINDOW tokens of both are hashed; one
with fewer than PLAIN_LEAST plain words says too little as a template and is hashed
by its words as they stand.

The benchmark's windows are a table.  The one scan of the documents hands on those
of their windows that pass a Bloom filter of it (FILTER_BITS bits, whatever the
benchmark's size), with their slot values, and a join by hash finds the rest.  A
window that many documents or items share is a hot key of that join, which
adaptive execution splits.  Nothing else of the benchmark is on the driver.
The join pairs a window with each item that has it, not with each place there: a
document and an item that both repeat a passage would make rows in the product of
their repetitions.  The windows of both meet at the judge, as many rows as they
have, where diagonals are made a block at a time.

Hits of a document and an item on one diagonal are one passage.  Windows with equal
slot values count.  Of the others, each slot value of the benchmark must have one
value in the document, by type and with forms of a unit as one: "3 apples ... 3"
against "5 apples ... 5" is the question with other parameters.  Where a value has
several, the most frequent holds (of equally frequent ones the unchanged one, or
else none), and windows over other ones don't count: "3 ... 3" against "5 ... 7" is
other text.

A document is contaminated by an item if, in either sequence, windows that count
cover COVERAGE of the item's windows, or PASSAGE or more equal words stand in one
run of them, however long the item is.

Edge cases: an item shorter than WINDOW is one window of its own length, and one
with fewer than LEAST_TOKENS tokens is looked for as words only; one without
tokens or with null text has none; a null or empty document has none; repeated
rows give one result, as do repeated items; a document without doc_id gives
results without doc_id; letters beyond Latin-1 keep their case; other columns are
ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import NOT_ALNUM, mix, shingle_hashes, slices, texts_of, word_hashes, word_spans
from .store import saved, table

WINDOW, LEAST_TOKENS, PLAIN_LEAST, COVERAGE, PASSAGE = 8, 4, 3, 0.5, 13
#: Bits of the filter, in cells of 64 (8 MB in a task).
FILTER_BITS = 1 << 26
#: Windows in a batch that leaves the scan; equal windows of a document and an item that are looked at together.
BATCH_ROWS, BLOCK = 4096, 1 << 18
# Units, their forms, number words, and function words that are no names when capitalised.
UNITS = (
    "percent kg g mg lb lbs oz km m cm mm mi mile miles ft feet foot inch inches yard yards l ml liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars euro euros pound pounds cent cents usd eur mph kph hz khz mhz kb mb gb tb w kw v degrees celsius fahrenheit"
).split()
_ONE_UNIT = {"lbs": "lb", "feet": "foot", "inches": "inch", "litre": "liter", "litres": "liter", "sec": "second", "min": "minute", "hr": "hour", "h": "hour", "s": "second"}
_ONE_UNIT |= {u: u[:-1] for u in UNITS if u[-1] == "s" and u[:-1] in UNITS and u not in _ONE_UNIT}
NUMBERS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())}
NUMBERS |= {w: str(10 * i) for i, w in enumerate("thirty forty fifty sixty seventy eighty ninety hundred".split(), 3)} | {"thousand": "1000", "million": "1000000"}
FUNCTION_WORDS = (
    "a about after all also although an and any are as at because been before between both but by can could did do does during each either every few find first for from "
    "give given had has have he her here hers him his how however i if in into is it its just let many may more most much must my neither no nor not now of on once only "
    "or other our out over per shall she should show since so some such than that the their them then there these they this those though through thus to under until up "
    "us was we were what when where whether which while who whom whose why will with within without would yet you your"
).split()
#: Sets hashes of both sequences, and of windows by words, apart.
_SALTS, _WORDS = (np.uint64(0), np.uint64(0x8EBC6AF09C88C6E3)), np.uint64(0xA0761D6478BD642F)
_NUMBER, _UNIT, _NAME = 1, 2, 3
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True


def _hashes_of(words) -> np.ndarray:
    words = list(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    data = np.frombuffer((" ".join(words) + " ").encode(), np.uint8)
    return np.sort(word_hashes(data, np.concatenate([[0], ends[:-1] + 1]), ends))


_UNIT_HASHES, _NUMBER_HASHES, _FUNCTION_HASHES = map(_hashes_of, (UNITS, NUMBERS, FUNCTION_WORDS))


def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


class Tokens:
    """Tokens of some texts: word hashes, kinds of slots, and where each token stands."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        low = data.copy()
        latin = np.zeros(len(data), dtype=bool)
        # Two-byte capitals of Latin-1: C3 80 to C3 9E, but for the multiplication sign.
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[latin] += 0x20
        digit, apart = _DIGIT[low], NOT_ALNUM[low]
        # A point or comma between digits belongs to the number.
        inner = np.zeros(len(data), dtype=bool)
        inner[1:-1] = ((low[1:-1] == 46) | (low[1:-1] == 44)) & digit[:-2] & digit[2:]
        # Bytes of separators become spaces, those of numbers digits, so that spans need no table of their own.
        plain = np.where(apart & ~inner, np.uint8(32), np.where(inner, np.uint8(48), low))
        starts, ends, _ = word_spans(plain, offs)
        digits = np.concatenate([[0], np.cumsum(digit | inner)])
        if len(starts):
            # Letters right after a number are a token of their own.
            turn = 1 + np.flatnonzero((digit | inner)[:-1] & ~(digit | inner | apart)[1:])
            of = np.searchsorted(starts, turn, side="right") - 1
            turn = turn[(turn < ends[of]) & (digits[turn] - digits[starts[of]] == turn - starts[of])]
            starts, ends = np.sort(np.concatenate([starts, turn])), np.sort(np.concatenate([ends, turn]))
        self.low, self.starts, self.ends, self.rows = low, starts, ends, np.searchsorted(starts, offs)
        self.words = word_hashes(low, starts, ends)
        self.slot = np.zeros(len(starts), dtype=np.uint8)
        self.spelt = np.zeros(len(starts), dtype=bool)
        if len(starts):
            number = digits[ends] - digits[starts] == ends - starts
            self.spelt = _among(self.words, _NUMBER_HASHES)
            after = np.zeros(len(starts), dtype=bool)
            after[1:] = (number | self.spelt)[:-1]
            after[self.rows[:-1][self.rows[:-1] < self.rows[1:]]] = False
            capital = _UPPER[data] | latin
            wide = data[starts] == 0xC3
            first = np.where(wide, capital[np.minimum(starts + 1, len(data) - 1)], capital[starts])
            second = np.minimum(starts + 1 + wide, len(data) - 1)
            shouted = (second >= ends) | capital[second] | ((data[second] == 0xC3) & capital[np.minimum(second + 1, len(data) - 1)])
            self.slot[first & ~shouted & ~_among(self.words, _FUNCTION_HASHES)] = _NAME
            self.slot[after & _among(self.words, _UNIT_HASHES)] = _UNIT
            self.slot[number | self.spelt] = _NUMBER

    def sequence(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that begin an element of the sequence of a kind, and their slots; kind 1 has names as words."""
        slot = self.slot if kind == 0 else np.where(self.slot == _NAME, 0, self.slot).astype(np.uint8)
        again = np.zeros(len(slot), dtype=bool)
        if len(slot):
            near = self.starts[1:] == self.ends[:-1] + 1
            near &= np.isin(np.arange(1, len(slot)), self.rows, invert=True)
            again[1:] = near & (((slot[1:] == _NAME) & (slot[:-1] == _NAME)) | (self.spelt[1:] & self.spelt[:-1]))
        at = np.flatnonzero(~again)
        return at, slot[at]

    def values(self, at: np.ndarray, slot: np.ndarray, i: int, width: int) -> list[str | None]:
        """Values of the slots among elements i to i + width - 1: the kind and the folded text."""
        out: list[str | None] = []
        for k in range(i, i + width):
            if not slot[k]:
                out.append(None)
                continue
            until = at[k + 1] if k + 1 < len(at) else len(self.starts)
            words = [self.low[self.starts[j] : self.ends[j]].tobytes().decode(errors="replace").lower() for j in range(at[k], until)]
            if slot[k] == _NUMBER:
                words = [NUMBERS.get(w, w.replace(",", "")) for w in words]
            elif slot[k] == _UNIT:
                words = [_ONE_UNIT.get(w, w) for w in words]
            out.append(f"{slot[k]}{' '.join(words)}")
        return out


def _windows(words: np.ndarray, slot: np.ndarray, kind: int, width: int) -> np.ndarray:
    """Hashes of all windows of a sequence; of fewer than PLAIN_LEAST plain words, or a width below LEAST_TOKENS, by the words alone."""
    if len(words) < width:
        return words[:0]
    salt = _SALTS[kind]
    templates = shingle_hashes(mix(np.where(slot > 0, slot.astype(np.uint64), words) ^ salt), width)
    literal = shingle_hashes(mix(words ^ salt ^ _WORDS), width)
    plain = np.concatenate([[0], np.cumsum(slot == 0)])
    few = plain[width:] - plain[:-width] < PLAIN_LEAST
    return literal if width < LEAST_TOKENS else np.where(few, literal, templates)


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in the filter."""
    shift = np.uint64(65 - FILTER_BITS.bit_length())
    return tuple((h >> shift).astype(np.int64) for h in (hashes, hashes * np.uint64(0x9E3779B97F4A7C15)))


ITEMS = "item_id long, item_hash long, kind int, width int, n_windows int, place int, hash long, bit_1 long, bit_2 long, item_values array<string>"
WINDOWS = "doc_id long, text_hash long, hash long, place int, word int, doc_values array<string>"
MET = "doc_id long, text_hash long, item_id long, item_hash long, kind int, n_windows int, side int, hash long, place int, word int, window_values array<string>"
FOUND = "doc_id long, item_id long, n_windows long, coverage double, first_word long, reworded boolean"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, h, text in zip(batch.column("item_id").to_pylist(), batch.column("item_hash").to_pylist(), batch.column("text").to_pylist()):
            data = np.frombuffer(text.encode(), np.uint8)
            t, rows = Tokens(data, np.array([0, len(data)])), []
            for kind in (0, 1):
                at, slot = t.sequence(kind)
                width = min(WINDOW, len(at))
                if width:
                    hashes = _windows(t.words[at], slot, kind, width)
                    for i, (x, a, b) in enumerate(zip(hashes.view(np.int64).tolist(), *(b.tolist() for b in _bits(hashes)))):
                        rows.append((item, h, kind, width, len(hashes), i, x, a, b, t.values(at, slot, i, width)))
            yield _batch(rows, ITEMS)


def _doc_windows(cells: Broadcast, widths: list[tuple[int, int]]) -> Callable:
    """Windows of the documents that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits = cells.value
        table_ = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
        table_[at] = bits
        known = lambda b: (table_[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1
        for batch in batches:
            ids, hashes = (batch.column(c).to_pylist() for c in ("doc_id", "text_hash"))
            for first, data, offs in slices(texts_of(batch.column("text"))):
                t, rows = Tokens(data, offs), []
                for kind in sorted({k for k, _ in widths}):
                    begins, slot = t.sequence(kind)
                    of = np.searchsorted(begins, t.rows)
                    for width in [w for k, w in widths if k == kind]:
                        h = _windows(t.words[begins], slot, kind, width)
                        one, two = _bits(h)
                        hit = np.flatnonzero(known(one))
                        hit = hit[known(two[hit])]
                        # A window stays within its text.
                        row = np.searchsorted(of, hit, side="right") - 1
                        inside = hit + width <= of[row + 1]
                        for i, r in zip(hit[inside].tolist(), row[inside].tolist()):
                            rows.append((ids[first + r], hashes[first + r], int(h[i].view(np.int64)), i - int(of[r]), int(begins[i] - t.rows[r]), t.values(begins, slot, i, width)))
                            if len(rows) >= BATCH_ROWS:
                                yield _batch(rows, WINDOWS)
                                rows = []
                if rows:
                    yield _batch(rows, WINDOWS)

    return run


Window = tuple[int, int, list, list]  # place, first word, values in the document, values in the item


def _kept(passage: list[Window]) -> tuple[list[Window], bool]:
    """The windows of one diagonal that count, and whether all of them have equal values."""
    if all(d == i for *_, d, i in passage):
        return passage, True
    pairs = {p + k: (i, d) for p, _, ds, is_ in passage for k, (d, i) in enumerate(zip(ds, is_)) if i is not None}
    images: dict[str, Counter] = defaultdict(Counter)
    for i, d in pairs.values():
        images[i][d] += 1
    holds = {}
    for i, seen in images.items():
        best = [d for d, n in seen.items() if n == max(seen.values())]
        holds[i] = best[0] if len(best) == 1 else i if i in best else None
    kept = [w for w in passage if w[2] == w[3] or all(i is None or holds[i] == d for d, i in zip(w[2], w[3]))]
    return kept, all(w[2] == w[3] for w in kept)


def _longest(kept: list[Window]) -> int:
    """The most equal words in one run of windows."""
    longest, run, last = 0, set(), None
    for place, _, ds, is_ in kept:
        if last is not None and place != last + 1:
            run = set()
        run |= {place + k for k, (d, i) in enumerate(zip(ds, is_)) if d == i}
        longest, last = max(longest, len(run)), place
    return longest


class _Side:
    """The windows of a document or an item, in order of place; equal values are held once."""

    def __init__(self) -> None:
        self.hash, self.place, self.word, self.of, self.values = array("q"), array("q"), array("q"), array("q"), {}

    def add(self, hash_: int, place: int, word: int, values: list) -> None:
        for column, v in ((self.hash, hash_), (self.place, place), (self.word, word), (self.of, self.values.setdefault(tuple(values), len(self.values)))):
            column.append(v)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(c, dtype=np.int64) for c in (self.hash, self.place, self.word, self.of))


def _passages(item: _Side, doc: _Side) -> Iterator[tuple[np.ndarray, ...]]:
    """(diagonal, place in the item, window of the document, window of the item) of equal windows, by diagonal and place, in blocks of whole diagonals."""
    (ih, ip, *_), (dh, dp, *_) = item.arrays(), doc.arrays()
    known = np.unique(ih)
    code, of = np.searchsorted(known, dh), np.searchsorted(known, ih)
    # The windows of one hash in order of place.
    wide = int(dp[-1]) + 1
    order = np.argsort(code * wide + dp)
    key = (code * wide + dp)[order]
    first, last, step = int(dp[0] - ip[-1]), int(dp[-1] - ip[0]), max(1, BLOCK // len(ip))
    for d in range(first, last + 1, step):
        low, high = (np.searchsorted(key, of * wide + np.clip(ip + x, 0, wide)) for x in (d, d + step))
        n = high - low
        if not n.any():
            continue
        i = np.repeat(np.arange(len(ip)), n)
        j = order[np.arange(len(i)) + np.repeat(low - np.cumsum(n) + n, n)]
        diagonal = dp[j] - ip[i]
        by = np.lexsort((ip[i], diagonal))
        yield diagonal[by], ip[i][by], j[by], i[by]


def _measured(item: _Side, doc: _Side, width: int) -> tuple[int, int | None, bool, int]:
    """Item windows covered, the first word, whether all values are equal, and the most equal words in a run."""
    (item_of, (_, _, words, doc_of)) = item.arrays()[3], doc.arrays()
    item_values, doc_values = list(item.values), list(doc.values)
    # Values of the document by their number in the item.
    same_as = np.array([item.values.get(v, -1) for v in doc_values], dtype=np.int64)
    covered, word, same, longest = set(), None, True, 0
    for diagonal, place, j, i in _passages(item, doc):
        begins = np.flatnonzero(np.append(True, diagonal[1:] != diagonal[:-1]))
        equal = same_as[doc_of[j]] == item_of[i]
        whole = np.logical_and.reduceat(equal, begins)
        on = np.repeat(whole, np.diff(np.append(begins, len(diagonal))))
        if on.any():
            covered.update(np.unique(place[on]).tolist())
            # On a diagonal the first place has the first word.
            least = int(words[j[begins[whole]]].min())
            word = least if word is None else min(word, least)
            d, p = diagonal[on], place[on]
            runs = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)))
            longest = max(longest, int(np.diff(np.append(runs, len(d))).max()) + width - 1)
        for a, b in zip(begins[~whole].tolist(), np.append(begins[1:], len(diagonal))[~whole].tolist()):
            kept, alike = _kept([(int(place[k]), int(words[j[k]]), doc_values[doc_of[j[k]]], item_values[item_of[i[k]]]) for k in range(a, b)])
            if kept:
                covered |= {w[0] for w in kept}
                word = min(kept[0][1], kept[0][1] if word is None else word)
                same, longest = same and alike, max(longest, _longest(kept))
    return len(covered), word, same, longest


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted windows of pairs, the item's before the document's, to contaminated documents; one pair's windows are held at a time."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    out = []
    for (doc, _, item, _), met in groupby(rows(), key=lambda r: r[:4]):
        best = None
        for (_, total), of_kind in groupby(met, key=lambda r: r[4:6]):
            sides, width = (_Side(), _Side()), 0
            for *_, side, hash_, place, word, values in of_kind:
                sides[side].add(hash_, place, word, values)
                width = len(values)
            # In one kind the pair may share nothing.
            if not len(sides[1].hash):
                continue
            n, word, same, longest = _measured(*sides, width)
            if n >= COVERAGE * total or longest >= PASSAGE:
                best = max(best or (0.0,), (n / total, same, n, word))
        if best:
            share, same, n, word = best
            out.append((doc, item, n, share, word, not same))
        if len(out) >= 10_000:
            yield _batch(out, FOUND)
            out = []
    yield _batch(out, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each contaminated document and item: the windows found, their share of the item's, the first token, and whether slot values differ."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    items = saved(items.select("item_id", F.xxhash64("text").alias("item_hash"), "text").mapInArrow(_item_windows, ITEMS), "items")
    cells = items.select(F.explode(F.array("bit_1", "bit_2")).alias("bit")).groupBy(F.expr("bit div 64").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 64)))").alias("bits")).toArrow()
    cells = spark.sparkContext.broadcast((cells.column("cell").to_numpy(), cells.column("bits").to_numpy().view(np.uint64)))
    # At most WINDOW widths of either kind.
    widths = sorted((r.kind, r.width) for r in items.select("kind", "width").distinct().collect())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where("text IS NOT NULL")
    windows = rows.mapInArrow(_doc_windows(cells, widths), WINDOWS)
    group = ["doc_id", "text_hash", "item_id", "item_hash"]
    holders = items.select("item_id", "item_hash", "kind", "n_windows", "hash").distinct()
    met = windows.join(holders, "hash").select(*group, "kind", "n_windows", F.lit(1).alias("side"), "hash", "place", "word", F.col("doc_values").alias("window_values"))
    met = saved(met.distinct(), "met")
    pairs = met.select(*group).distinct().alias("m")
    of_items = pairs.join(items.alias("i"), F.expr("m.item_hash = i.item_hash AND m.item_id <=> i.item_id"))
    of_items = of_items.select("doc_id", "text_hash", "m.item_id", "m.item_hash", "kind", "n_windows", F.lit(0).alias("side"), "hash", "place", F.lit(0).alias("word"), F.col("item_values").alias("window_values"))
    met = met.unionByName(of_items).repartition(*group).sortWithinPartitions(*group, "kind", "n_windows", "side", "place", "word")
    return met.mapInArrow(_judge, FOUND)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("coverage", F.round("coverage", 6))
