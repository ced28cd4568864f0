"""Exact n-gram Jaccard join in the Jaccard metric space, with pivots.

With r = 1 - threshold, two documents link when their Jaccard distance is at
most r.  Documents with equal shingle sets are one class, joined through one
representative.  The join then works on regions:

* A region is the set of representatives that hold one shingle in their prefix
  (rarest shingles first; linked pairs always share a prefix shingle).  The
  size window and the position of the shared shingle bound which members can
  link at all.
* A region of up to LEAF members is joined directly.  Every larger one, whatever
  its shingle, takes its most central member as pivot p and every member x gets
  its exact distance d(x, p) and its difference set x ^ p.  Members within r link to the pivot, so no pair inside
  that ball is needed for the components.  How many of them link is counted from
  the difference sets, in blocks of SLICE by SLICE members, and only counts leave
  a block.  A pair in several balls counts in the one of the smallest pivot.
* Triangle inequality: |d(x,p) - d(y,p)| <= r for linked x, y.  Hence pairs lie
  either both within 3r of p or both beyond 2r; members in between are boundary
  documents and are replicated to both sides.
* The near side is joined again, recursively, on the difference sets: linked x
  and y that are not both within r of p must share elements of x ^ p and y ^ p
  (|x ^ y| = |x ^ p| + |y ^ p| - 2 |both|), so (p, element) are its regions.
  The far side is joined under the size window.  Groups of either side are cut
  in slices of SLICE members that meet two by two in blocks, each a task's work
  of bounded size; blocks without a pair that is still open are not made.
* Places first meet sketches: the parities of a set's hashes in about as many
  bits as it has elements.  Sketches of two sets differ in at most as many bits
  as the sets in elements, so a place whose sketch differs too much from all it
  would be compared with links with none of them, and its text stays where it is.
* Every surviving pair is verified on whole shingle sets.  Connected components
  of the links come from alternating large-star and small-star steps.

Nothing is capped: the list of frequent shingles fixes the rarest-first order,
and any order gives the same links; region sizes are counted over all prefixes.
A shingle of the list is counted before the shuffle, any other one as its rows
stream by, and beyond LEAF rows pass on to the pivot without being held.

Edge cases: a null or wordless text has an empty set and links with nothing; a
text of fewer than n words is one shingle; repeated rows are members of one
class; rows that share a doc_id are documents of their own, and so are rows
without one, whose class or component has a null id if all its members have;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import shingle_sets, texts_of
from .store import release, saved, table

#: Regions up to this size are joined directly.
LEAF = 64
#: Shingles counted this often are put last in the rarest-first order; at most ORDER_MOST of them (2 MB).
ORDER_COUNT, ORDER_MOST = 16, 262_144
#: Shingles counted at a time in a task (32 MB with the sort).
COUNT_SLICE = 1 << 21
#: Members of a region that are compared with its pivot in one task; members of a group on each side of a block.
SLICE = 256
#: Bits of the filter by which documents without a place stay out of the join with places (262,144 cells, 4 MB).
FILTER_BITS = 1 << 24
#: Columns of the dense tables in which a block's shared elements are counted (2 MB a side).
COLUMNS = 2048

_FLIP = np.uint64(1 << 63)


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as longs of the same order."""
    return (x ^ _FLIP).view(np.int64)


class Threshold:
    """100 * |x & y| >= percent * |x | y|, in integers."""

    def __init__(self, percent: int) -> None:
        self.p = percent

    def least(self, n):
        """Smallest partner size, and smallest overlap with any partner, of a set of size n."""
        return -(-self.p * n // 100)

    def overlap(self, n, m):
        return -(-self.p * (n + m) // (100 + self.p))

    def links(self, both, n, m):
        return 100 * both >= self.p * (n + m - both)

    def diff(self, n, m):
        """Largest symmetric difference of linked sets of sizes n and m."""
        return n + m - 2 * self.overlap(n, m)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def _numpy(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _repeated_rows(k: int) -> Callable:
    """Shingles that several documents of a slice share, with their number: what is frequent overall repeats in most slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(_signed(values[many])), pa.array(counts[many])], ["s", "c"])

        for batch in batches:
            for s in shingle_sets(texts_of(batch.column("text")), k):
                held.append(s)
                size += len(s)
                if size >= COUNT_SLICE:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return run


def _among(x: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted array."""
    if not len(frequent):
        return np.zeros(len(x), dtype=bool)
    return frequent[np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)] == x


def _sketch(s: np.ndarray) -> bytes:
    """Parities of a set's hashes in a power of two of bits, at least as many as elements and 64."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch in so many words, which is the set's sketch of that width."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def _set_rows(k: int, t: Threshold, frequent: np.ndarray) -> Callable:
    """Per document: size, key of the set, sketch, and prefix in rarest-first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sketches, prefixes = [], [], [], []
            for s in shingle_sets(texts_of(batch.column("text")), k):
                n = len(s)
                sizes.append(n)
                keys.append(blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                sketches.append(_sketch(s) if n else None)
                s = _signed(s)
                last = _among(s, frequent)
                if last.any():
                    s = np.concatenate([s[~last], s[last]])
                prefixes.append(s[: n - t.least(n) + 1] if n else s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), _lists(prefixes)],
                ["doc_id", "n", "key", "sketch", "prefix"],
            )

    return run


class _Pairs:
    """Collects result columns and hands them out as batches, with ``once`` each (first, second) once a batch."""

    def __init__(self, names: list[str], once: bool = False) -> None:
        self.names, self.once, self.parts, self.rows = names, once, [], 0

    def add(self, *columns: np.ndarray, weight: int = 0) -> None:
        if len(columns[0]):
            self.parts.append(columns)
            self.rows += len(columns[0]) + weight

    def ready(self, least: int = 20_000) -> Iterator[pa.RecordBatch]:
        if self.rows >= max(least, 1):
            columns = [np.concatenate(c) for c in zip(*self.parts)]
            if self.once:
                order = np.lexsort(columns[::-1])
                columns = [c[order] for c in columns]
                same = (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])
                # Of equal places the last one in order is whole if any is.
                columns = [c[np.append(~same, True)] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if c.dtype == object else None) for c in columns], self.names)
            self.parts, self.rows = [], 0


def _groups(batches: Iterator[pa.RecordBatch], key: list[str], most: int) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """(columns, bounds of runs of equal keys, which runs are large) of sorted batches.

    A run of up to ``most`` rows comes whole; a larger one comes in pieces, none of them held back.
    """
    held, passing = None, None
    for batch in batches:
        cols = {c: _numpy(batch.column(c)) for c in batch.schema.names}
        if held is not None:
            cols, held = {c: np.concatenate([held[c], v]) for c, v in cols.items()}, None
        rows = len(cols[key[0]])
        if not rows:
            continue
        new = np.zeros(rows - 1, dtype=bool)
        for c in key:
            new |= cols[c][1:] != cols[c][:-1]
        bounds = np.concatenate([[0], np.flatnonzero(new) + 1, [rows]])
        large = np.diff(bounds) > most
        large[0] |= passing is not None and all(cols[c][0] == v for c, v in passing.items())
        passing = {c: cols[c][-1] for c in key} if large[-1] else None
        if large[-1]:
            yield cols, bounds, large
        else:
            # The last run may go on.
            yield cols, bounds[:-1], large[:-1]
            held = {c: v[bounds[-2] :] for c, v in cols.items()}
    if held is not None:
        yield held, np.array([0, len(held[key[0]])]), np.array([False])


def _place(out: _Pairs, ids: np.ndarray, partners: Callable[[int], np.ndarray]) -> None:
    """Places of a group's members that have partners: rows (p, id, whole).

    Up to LEAF such members share the region of the smallest of them, where all
    pairs are looked at (whole).  Of more, each meets its own partners only.
    """
    found = [(i, js) for i in range(len(ids) - 1) if len(js := partners(i))]
    if not found:
        return
    members = np.unique(np.concatenate([ids[[i for i, _ in found]], *(ids[js] for _, js in found)]))
    if len(members) <= LEAF:
        out.add(np.full(len(members) - 1, members[0]), members[1:], np.ones(len(members) - 1, dtype=bool))
        return
    for i, js in found:
        out.add(np.minimum(ids[js], ids[i]), np.maximum(ids[js], ids[i]), np.zeros(len(js), dtype=bool))


def _window(t: Threshold, n: np.ndarray, i: int) -> slice:
    """Later members of a run sorted by size that member i may link with."""
    return slice(i + 1, int(np.searchsorted(n, n[i] * 100 // t.p, side="right")))


def _by_prefix(t: Threshold, ids: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Callable[[int], np.ndarray]:
    """Partners of a member by sizes and by the places of the shared shingle in both prefixes."""

    def partners(i: int) -> np.ndarray:
        js = _window(t, n, i)
        need = t.overlap(n[i], n[js])
        return i + 1 + np.flatnonzero((pos[i] <= n[i] - need) & (pos[js] <= n[js] - need) & (ids[js] != ids[i]))

    return partners


def _by_difference(t: Threshold, ids: np.ndarray, n: np.ndarray, pos: np.ndarray, size: np.ndarray, linked: np.ndarray) -> Callable[[int], np.ndarray]:
    """Partners of a member by the places of the shared element in both difference sets; pairs inside the ball are linked already."""

    def partners(i: int) -> np.ndarray:
        js = _window(t, n, i)
        need = np.maximum(1, -(-(size[i] + size[js] - t.diff(n[i], n[js])) // 2))
        ok = (pos[i] <= size[i] - need) & (pos[js] <= size[js] - need) & (ids[js] != ids[i])
        return i + 1 + np.flatnonzero(ok & ~(linked[js] & linked[i]))

    return partners


LIGHT = "p long, id long, whole boolean, s long, n long, pos long"


def _light(t: Threshold) -> Callable:
    """Places by the pairs of each region of up to LEAF rows (pos -1); rows of larger regions pass as they are.

    Rows are sorted by region and size.
    """
    names = [c.split()[0] for c in LIGHT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Pairs(["p", "id", "whole"], once=True)

        def ready(least: int) -> Iterator[pa.RecordBatch]:
            for b in out.ready(least):
                zeros = np.zeros(len(b), np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(zeros), pa.array(zeros), pa.array(zeros - 1)], names)

        for cols, bounds, large in _groups(batches, ["s"], LEAF):
            sizes = np.diff(bounds)
            for g in np.flatnonzero((sizes > 1) & ~large).tolist():
                here = slice(int(bounds[g]), int(bounds[g + 1]))
                ids = cols["rep"][here]
                _place(out, ids, _by_prefix(t, ids, cols["n"][here], cols["pos"][here]))
            if large.any():
                at = bounds[0] + np.flatnonzero(np.repeat(large, sizes))
                s, rep, n, pos = (pa.array(cols[c][at]) for c in ("s", "rep", "n", "pos"))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int64)), rep, pa.array(np.zeros(len(at), dtype=bool)), s, n, pos], names)
            yield from ready(200_000)
        yield from ready(1)

    return run


def _blocks(rows: DataFrame, key: list[str], open_: str) -> DataFrame:
    """Rows of groups with their slice (own) in each block (i, j) of two slices that holds an open row.

    Groups of up to SLICE rows are one block; groups without an open row, or of one row, have none.
    """
    sizes = rows.groupBy(*key).agg(F.count_if(F.expr(open_)).alias("u"), F.count("*").alias("size")).where("u > 0 AND size > 1")
    sizes = sizes.select(*key, F.expr(f"cast(ceil(if(size <= {SLICE}, 1, u / {SLICE})) AS long)").alias("wide"), F.expr(f"if(size <= {SLICE}, 0L, cast(ceil((size - u) / {SLICE}) AS long))").alias("rest"))
    rows = rows.join(sizes, key).withColumn("own", F.expr(f"if(({open_}) OR rest = 0, pmod(xxhash64(rep), wide), wide + pmod(xxhash64(rep), rest))"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, if(own < wide, wide + rest, wide) - 1)")))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "wide", "rest")
    return rows.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j", "n", "rep")


def _block_places(t: Threshold, key: list[str], columns: tuple[str, ...], rule: Callable) -> Callable:
    """Places by the pairs of each block; a pair of one slice is looked at in that slice's own block only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Pairs(["p", "id", "whole"], once=True)
        for cols, bounds, _ in _groups(batches, [*key, "i", "j"], 1 << 62):
            for g in np.flatnonzero(np.diff(bounds) > 1).tolist():
                here = slice(int(bounds[g]), int(bounds[g + 1]))
                ids, own = cols["rep"][here], cols["own"][here]
                partners = rule(t, ids, *(cols[c][here] for c in columns))
                if cols["i"][here.start] != cols["j"][here.start]:
                    every = partners
                    partners = lambda i, every=every, own=own: (js := every(i))[own[js] != own[i]]
                _place(out, ids, partners)
                yield from out.ready(200_000)
        yield from out.ready(1)

    return run


def _against_pivot(k: int, t: Threshold, frequent: np.ndarray, elements: bool) -> Callable:
    """Streams regions: the pivot's text comes first, then each member's.

    Without ``elements``: links (a, b), between the pivot and all members and
    among the whole ones, which are held in memory (at most two slices of them).
    With it: a row with its distance per member, which has the
    difference set of a linked one, and for members within 3r the leading elements
    of the difference set, each a region key.
    """
    radius = 1 - t.p / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, base, held_ids, held_sets = None, None, [], []
        out = _Pairs(["p", "rep", "linked", "dist", "e", "n", "size", "pos", "diff"] if elements else ["a", "b"])
        for batch in batches:
            ps, first = batch.column("p").to_pylist(), batch.column("member").to_pylist()
            ids, whole = batch.column("id").to_pylist(), batch.column("whole").to_pylist()
            for i, x in enumerate(shingle_sets(texts_of(batch.column("text")), k)):
                p, x = ps[i], _signed(x)
                if not first[i]:
                    if len(held_ids) > 1:
                        out.add(*_links_among(held_ids, held_sets, t))
                    pivot, base, held_ids, held_sets = p, x, [p], [x]
                    continue
                if pivot != p:
                    raise ValueError(f"pivot {p} has no shingle set")
                if whole[i]:
                    held_ids.append(ids[i])
                    held_sets.append(x)
                    continue
                both = np.isin(x, base, assume_unique=True)
                common, n, m = int(both.sum()), len(x), len(base)
                linked = bool(t.links(common, n, m))
                if not elements:
                    if linked:
                        out.add(np.array([min(p, ids[i])]), np.array([max(p, ids[i])]))
                    continue
                dist = 1 - common / (n + m - common)
                whole_diff = np.full(1, None, dtype=object)
                if linked:
                    whole_diff[0] = np.concatenate([x[~both], base[~np.isin(base, x, assume_unique=True)]]).tobytes()
                out.add(*map(np.array, ([p], [ids[i]], [linked], [dist], [0], [n], [0], [-1])), whole_diff, weight=n + m - 2 * common >> 3)
                if dist <= 3 * radius + 1e-9:
                    added = x[~both]
                    last = _among(added, frequent)
                    delta = np.concatenate([added[~last], added[last], base[~np.isin(base, x, assume_unique=True)]])
                    size, c = len(delta), (100 - t.p) / (100 + t.p)
                    # Fewest elements shared with any partner, see the module's text.
                    least = (1 - c) * size / 2 if linked else (size + 1 - c - c * (n + m)) / 2
                    keep = size - max(1, int(np.ceil(least - 1e-9))) + 1
                    if keep > 0:
                        full = lambda v, k=keep: np.full(k, v)
                        out.add(full(p), full(ids[i]), full(linked), full(dist), delta[:keep], full(n), full(size), np.arange(keep), np.full(keep, None, dtype=object))
            yield from out.ready()
        if len(held_ids) > 1:
            out.add(*_links_among(held_ids, held_sets, t))
        yield from out.ready(1)

    return run


def _links_among(ids: list[int], sets: list[np.ndarray], t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs of a region's members, by counting shared shingles over its inverted index."""
    sizes = np.array(list(map(len, sets)))
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    _, first, count = np.unique(flat[order], return_index=True, return_counts=True)
    start, length = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
    start[order], length[order] = np.repeat(first, count), np.repeat(count, count)
    held, ends, left, right = owner[order], np.cumsum(sizes), [], []
    for i, end in enumerate(ends.tolist()):
        at, many = start[end - sizes[i] : end], length[end - sizes[i] : end]
        at, many = at[many > 1], many[many > 1]
        posts = np.arange(many.sum()) + np.repeat(at - np.cumsum(many) + many, many)
        both = np.bincount(held[posts], minlength=len(sets))[i + 1 :]
        js = i + 1 + np.flatnonzero((both > 0) & t.links(both, sizes[i], sizes[i + 1 :]))
        left += [ids[i]] * len(js)
        right += [ids[j] for j in js.tolist()]
    a, b = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
    return np.minimum(a, b), np.maximum(a, b)


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of elements that each set on the left shares with each on the right."""
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    of_a, of_b = (np.repeat(np.arange(len(x)), list(map(len, x))) for x in (left, right))
    values = np.intersect1d(a, b)
    keep_a, keep_b = np.isin(a, values), np.isin(b, values)
    at_a, of_a = np.searchsorted(values, a[keep_a]), of_a[keep_a]
    at_b, of_b = np.searchsorted(values, b[keep_b]), of_b[keep_b]
    for c in range(0, len(values), COLUMNS):
        sides = []
        for at, of, n in ((at_a, of_a, len(left)), (at_b, of_b, len(right))):
            here = (at >= c) & (at < c + COLUMNS)
            side = np.zeros((n, min(COLUMNS, len(values) - c)), dtype=np.float32)
            side[of[here], at[here] - c] = 1
            sides.append(side)
        total += (sides[0] @ sides[1].T).astype(np.int64)
    return total


def _block_links(t: Threshold, left: list[tuple], right: list[tuple] | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, links) of a block of a ball's members (id, n, difference set, smaller pivots of it): pairs without a smaller common pivot, among ``left`` if there is no right."""
    a, b = left, left if right is None else right
    smaller = _shared([x[3] for x in a], [x[3] for x in b])
    open_ = smaller == 0
    if right is None:
        open_ &= np.triu(np.ones(open_.shape, dtype=bool), 1)
    rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if not len(rows):
        return rows, rows
    a, b, open_ = [a[i] for i in rows], [b[i] for i in cols], open_[np.ix_(rows, cols)]
    n, m = np.array([x[1] for x in a])[:, None], np.array([x[1] for x in b])[None, :]
    apart = np.array([len(x[2]) for x in a])[:, None] + np.array([len(x[2]) for x in b])[None, :] - 2 * _shared([x[2] for x in a], [x[2] for x in b])
    linked = t.links((n + m - apart) // 2, n, m) & open_
    return np.array([x[0] for x in a] + [x[0] for x in b]), np.concatenate([linked.sum(axis=1), linked.sum(axis=0)])


def _ball_counts(t: Threshold) -> Callable:
    """Links of each member inside each block (p, i, j) of a ball; a block's rows follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, sides = _Pairs(["node", "c"]), None, ([], [])

        def close() -> None:
            left, right = sides
            if key and left and (right or key[1] == key[2]):
                ids, c = _block_links(t, left, None if key[1] == key[2] else right)
                out.add(ids[c > 0], c[c > 0])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("p", "i", "j", "own", "rep", "n", "diff", "less")]
            for p, i, j, own, rep, n, diff, less in zip(*cols):
                if key != (p, i, j):
                    close()
                    key, sides = (p, i, j), ([], [])
                sides[int(own != i)].append((rep, n, np.frombuffer(diff, np.int64), np.array(less, dtype=np.int64)))
            yield from out.ready()
        close()
        yield from out.ready(1)

    return run


def _links_in_balls(balls: DataFrame, pivots: DataFrame, t: Threshold) -> DataFrame:
    """(node, c): links between members of one ball (p, rep, n, diff); pivots has the balls of each rep."""
    width = balls.groupBy("p").agg(F.count("*").alias("size")).where("size > 1").select("p", F.expr(f"cast(ceil(size / {SLICE}) AS long)").alias("width"))
    rows = balls.join(width, "p").join(pivots, "rep")
    rows = rows.select("p", "rep", "n", "diff", "width", F.expr("pmod(xxhash64(rep), width)").alias("own"), F.expr("filter(pivots, q -> q < p)").alias("less"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, width - 1L)")))
    rows = rows.select("p", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "diff", "less")
    return rows.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j").mapInArrow(_ball_counts(t), "node long, c long")


def _holding(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is among the ids (id), and few others: what a bitmap of fixed size can tell without a shuffle of texts."""
    bit = f"pmod(xxhash64({{}}), {FILTER_BITS}L)"
    cells = ids.select(F.expr(bit.format("id")).alias("bit")).groupBy(F.expr("bit div 64").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 64)))").alias("bits"))
    marked = docs.withColumn("bit", F.expr(bit.format("doc_id"))).withColumn("cell", F.expr("bit div 64"))
    # At most FILTER_BITS / 64 cells.
    return marked.join(F.broadcast(cells), "cell").where("bit_get(bits, int(bit % 64)) = 1").select(docs.columns)


def _may_link(t: Threshold, n: np.ndarray, sketches: list[np.ndarray], whole: int) -> np.ndarray:
    """Which rows may link with the first one, or one of the first ``whole`` rows with another of these, by sizes and sketches."""
    words = np.array(list(map(len, sketches)))
    tables = {w: np.array([_folded(x, w) if len(x) >= w else np.zeros(w, np.uint64) for x in sketches]) for w in np.unique(words).tolist()}
    kept = np.zeros(len(n), dtype=bool)
    for i in range(whole):
        js = np.arange(i + 1, whole if i else len(n))
        js = js[np.minimum(n[i], n[js]) >= t.least(np.maximum(n[i], n[js]))]
        width = np.minimum(words[i], words[js])
        for w in np.unique(width).tolist():
            at = js[width == w]
            at = at[np.bitwise_count(tables[w][at] ^ tables[w][i]).sum(axis=1) <= t.diff(n[i], n[at])]
            kept[at] = True
            kept[i] |= len(at) > 0
    return kept


def _open(t: Threshold) -> Callable:
    """Rows of regions, the pivot's first and then whole members, without members whose sketches rule out every link; a region without members goes whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, [], []

        def close() -> None:
            if len(held) > 1:
                n, sketches = np.array([x[1] for x in held]), [np.frombuffer(x[2], np.uint64) for x in held]
                kept = _may_link(t, n, sketches, sum(x[3] for x in held))
                if kept.any():
                    found.extend((id_, *key, i > 0, whole) for i, (id_, _, _, whole) in enumerate(held) if kept[i] or not i)

        def ready() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            columns = list(zip(*found)) or [()] * len(types)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types)], ["id", "p", "cut", "member", "whole"])

        for batch in batches:
            for p, cut, *row in zip(*(batch.column(c).to_pylist() for c in ("p", "cut", "id", "n", "sketch", "whole"))):
                if key != (p, cut):
                    close()
                    key, held = (p, cut), []
                held.append(row)
            yield ready()
        close()
        yield ready()

    return run


def _verified(docs: DataFrame, places: DataFrame, k: int, t: Threshold, frequent: np.ndarray, sketches: DataFrame | None) -> DataFrame:
    """Every place (p, id, whole) against whole sets, region by region; large regions are cut in slices that all get the pivot.

    With sketches (doc_id, n, sketch), links of the places that these leave open; without them, distances and elements of all places.
    """
    elements = sketches is None
    schema = "p long, rep long, linked boolean, dist double, e long, n long, size long, pos long, diff binary" if elements else "a long, b long"
    places = saved(places.groupBy("p", "id").agg(F.max("whole").alias("whole")), "places", narrow=True)
    slices = lambda which: F.expr(f"cast(ceil(count_if({which}) / {SLICE}) AS long)")
    width = places.groupBy("p").agg(slices("whole").alias("wide"), slices("NOT whole").alias("parts"))
    # Whole members meet in blocks (negative cuts) where they are more than a slice; others are dealt to the cuts from 1 on.
    own = "pmod(xxhash64(id), wide)"
    blocks = f"transform(sequence(0L, wide - 1L), o -> -1L - least({own}, o) * wide - greatest({own}, o))"
    cuts = F.expr(f"CASE WHEN NOT whole THEN array(1L + pmod(xxhash64(id), parts)) WHEN wide > 1 THEN {blocks} ELSE array(0L) END")
    members = places.join(width, "p").select("id", "p", F.explode(cuts).alias("cut"), F.lit(True).alias("member"), "whole")
    pivots = members.select("p", "cut").distinct().select(F.col("p").alias("id"), "p", "cut", F.lit(False).alias("member"), F.lit(True).alias("whole"))
    sliced = saved(pivots.unionByName(members), "sliced", narrow=True)
    release(places)
    places = sliced
    if not elements:
        rows = places.join(sketches.hint("merge"), F.col("id") == F.col("doc_id")).select("p", "cut", "member", "whole", "id", "n", "sketch")
        rows = rows.repartition("p", "cut").sortWithinPartitions("p", "cut", "member", F.desc("whole"), "id")
        places = saved(rows.mapInArrow(_open(t), "id long, p long, cut long, member boolean, whole boolean"), "open")
        release(sliced)
    # Texts are dealt by document and then by region, at every size alike.
    rows = _holding(docs, places).join(places.hint("merge"), F.col("doc_id") == F.col("id")).select("p", "cut", "member", "whole", "id", "text")
    rows = rows.repartition("p", "cut").sortWithinPartitions("p", "cut", "member", F.desc("whole"), "id")
    return rows.mapInArrow(_against_pivot(k, t, frequent, elements), schema)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all linked nodes; component is the smallest node reachable.  Links: a < b, longs."""
    edges = saved(links.select("a", "b").where("a < b").distinct(), "links", narrow=True)
    while True:
        # large-star: larger neighbours of u move to the smallest of u and its neighbours
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sides.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = saved(large, "large", narrow=True)
        # small-star: smaller neighbours of u, and u, move to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("a", "b", "m")
        small = small.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b"))
        after = saved(small.distinct(), "small", narrow=True)
        # A forest of stars: every node hangs on one root, and no root hangs on another.
        b = after.groupBy("b").agg(F.count("*").alias("parents"))
        loose = b.where("parents > 1").limit(1).count() or after.select("a").distinct().join(b, F.col("a") == b.b, "left_semi").limit(1).count()
        release(edges, large)
        edges = after
        if not loose:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_shingles, class_id, n_links, component_id.

    class_id is the smallest doc_id with the same shingle set; n_links counts all links of the class with other classes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        return _joined(docs, n, percent)
    # Rows get keys in the order of doc_id, so a component's smallest key is of its smallest doc_id.
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    keyed = saved(docs.repartitionByRange(*order[:2]).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()), "keyed")
    found = _joined(keyed.select(F.col("row").alias("doc_id"), "text"), n, percent)
    for c in ("class_id", "component_id", "doc_id"):
        found = found.withColumnRenamed(c, "row").join(keyed.select("row", F.col("doc_id").alias(c)), "row").drop("row")
    return found.select("doc_id", "n_shingles", "class_id", "n_links", "component_id")


def _joined(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The join of documents with one doc_id each."""
    t = Threshold(percent)
    counts = docs.select("text").mapInArrow(_repeated_rows(n), "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
    top = counts.where(F.col("c") >= ORDER_COUNT).orderBy(F.desc("c"), "s").limit(ORDER_MOST).select("s").toArrow()
    frequent = np.sort(top.column("s").to_numpy())
    rows = saved(docs.mapInArrow(_set_rows(n, t, frequent), "doc_id long, n long, key binary, sketch binary, prefix array<long>"), "rows")
    classes = saved(
        rows.where("key is not null")
        .groupBy("key")
        .agg(F.min(F.struct("doc_id", "n", "prefix")).alias("r"))
        .select("key", F.col("r.doc_id").alias("rep"), "r.n", "r.prefix"),
        "classes",
    )
    ids = saved(rows.select("doc_id", "n", "key", "sketch"), "ids")
    release(rows)
    held = classes.select("rep", "n", F.posexplode("prefix").alias("pos", "s")).withColumn("pos", F.col("pos").cast("long"))
    place, light, heavy = "p long, id long, whole boolean", held, None
    if len(frequent):
        many = held.sparkSession.createDataFrame(pa.table({"s": frequent}))
        light = held.join(F.broadcast(many), "s", "left_anti")
        heavy = held.join(F.broadcast(many), "s", "left_semi")
        heavy = heavy.join(heavy.groupBy("s").agg(F.count("*").alias("size")).where("size > 1"), "s")
        light = light.select("s", "rep", "n", "pos").unionByName(heavy.where(f"size <= {LEAF}").select("s", "rep", "n", "pos"))
        heavy = heavy.where(f"size > {LEAF}").select("s", "rep", "n", "pos")
    light = light.select("s", "rep", "n", "pos").repartition("s").sortWithinPartitions("s", "n", "rep")
    light = saved(light.mapInArrow(_light(t), LIGHT), "light")
    found = [light.where("pos < 0").select("p", "id", "whole")]
    large = light.where("pos >= 0").select("s", F.col("id").alias("rep"), "n", "pos")
    large = large if heavy is None else large.unionByName(heavy)
    led = large.groupBy("s").agg(F.min(F.struct("pos", "rep")).alias("led")).select("s", F.col("led.rep").alias("p"))
    large = saved(large.join(led, "s"), "large", narrow=True)
    names = saved(classes.select("key", "rep"), "names", narrow=True)
    release(classes)
    links, balls = [], None
    if large.limit(1).count():
        members = large.where("rep != p").select("p", F.col("rep").alias("id"), F.lit(False).alias("whole"))
        region = saved(_verified(docs, members, n, t, frequent, None), "region")
        seen = region.where("pos = -1").select("p", "rep", "linked", "dist")
        near = _blocks(region.where("pos >= 0").select("p", "e", "rep", "n", "pos", "size", "linked"), ["p", "e"], "NOT linked")
        far = seen.where(F.col("dist") > 2 * (1 - percent / 100) - 1e-9).select("p", "rep")
        far = _blocks(large.join(far, ["p", "rep"]).select("s", "rep", "n", "pos"), ["s"], "true")
        balls = region.where("pos = -1 AND linked").select("p", "rep", "n", "diff")
        links = [seen.where("linked").select(F.least("p", "rep").alias("a"), F.greatest("p", "rep").alias("b"))]
        found.append(near.mapInArrow(_block_places(t, ["p", "e"], ("n", "pos", "size", "linked"), _by_difference), place))
        found.append(far.mapInArrow(_block_places(t, ["s"], ("n", "pos"), _by_prefix), place))
    every = found[0]
    for x in found[1:]:
        every = every.union(x)
    done = _verified(docs, every, n, t, frequent, ids.select("doc_id", "n", "sketch"))
    for x in links:
        done = done.union(x)
    done = saved(done.distinct(), "verified", narrow=True)
    joined = components(done)
    apart, inside = done, []
    if balls is not None:
        pivots = balls.groupBy("rep").agg(F.collect_list("p").alias("pivots"))
        # Pairs of one ball are counted there.
        sides = [pivots.select(F.col("rep").alias(c), F.col("pivots").alias(f"of_{c}")) for c in ("a", "b")]
        apart = done.join(sides[0], "a", "left").join(sides[1], "b", "left").where("NOT coalesce(arrays_overlap(of_a, of_b), false)").select("a", "b")
        inside = [_links_in_balls(balls, pivots, t)]
    degree = apart.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("c"))
    for x in inside:
        degree = degree.union(x)
    degree = degree.groupBy("node").agg(F.sum("c").alias("n_links"))
    named = names.join(joined.join(degree, "node", "left"), F.col("rep") == F.col("node"), "left")
    named = named.select("key", "rep", "n_links", F.coalesce("component", "rep").alias("component"))
    # Documents without a set meet no key.
    bare = ids.where("key IS NULL").select("doc_id", "n", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"))
    keyed = ids.where("key IS NOT NULL").join(named, "key", "left").select("doc_id", "n", "rep", "n_links", "component")
    return keyed.union(bare).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("rep", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), n=4, percent=85)
