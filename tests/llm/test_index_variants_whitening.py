"""Brute force and edge cases of the run-length index, spelling variants and whitening."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from llm import run_index, spelling_variants, whitening
from llm.store import table

SCHEMA = "doc_id long, text string, h string, word string"


# 11 -------------------------------------------------------------------------------------------------------------


def brute_matches(strings):
    found = []
    for i, s in enumerate(strings):
        for p in range(len(s)):
            best = 0
            for j, t in enumerate(strings):
                for q in range(len(t)):
                    if (i, p) != (j, q):
                        k = 0
                        while p + k < len(s) and q + k < len(t) and s[p + k] == t[q + k]:
                            k += 1
                        best = max(best, k)
            found.append(best)
        found.append(0)
    return found


def test_index_gives_matching_statistics():
    r = random.Random(5)
    for _ in range(60):
        letters = r.choice([b"ab", b"abc", bytes(range(256))])
        base = bytes(r.choice(letters) for _ in range(r.randint(1, 50)))
        strings = [base[r.randint(0, len(base)) :] + bytes(r.choice(letters) for _ in range(r.randint(0, 8))) + base[: r.randint(0, len(base))] for _ in range(r.randint(1, 6))]
        index = run_index.RunIndex(strings)
        assert index.statistics().tolist() == brute_matches(strings)
        assert int(index.lengths.sum()) == index.size and len(index.heads) <= index.size


def test_index_of_copies_has_few_runs():
    text = random.Random(1).randbytes(3000)
    index = run_index.RunIndex([text] * 20)
    assert len(index.heads) < 2 * len(text) < index.size / 9


def brute_removed(rows, window):
    starts = Counter(t[p : p + window] for _, t in rows for p in range(len(t) - window + 1))
    found = []
    for d, t in rows:
        gone = [False] * len(t)
        for p in range(len(t) - window + 1):
            if starts[t[p : p + window]] > 1:
                gone[p : p + window] = [True] * window
        kept = bytes(b for b, g in zip(t, gone) if not g)
        found.append((d, len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), sha256(kept).hexdigest()))
    return sorted(found, key=repr)


def long_texts(r):
    """Copies, edges of shared passages, runs of one letter, repeats inside a text, nulls, short and non-ASCII texts."""
    word = lambda: r.choice("an be co dé en fo gà hi in ja ко la".split())
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, page = prose(40), prose(200)
    rows = [prose(r.randint(0, 120)) for _ in range(20)]
    rows += [f"{prose(r.randint(1, 20))} {passage[r.randint(0, 10) : len(passage) - r.randint(0, 10)]} {prose(r.randint(1, 20))}" for _ in range(12)]
    rows += [page] * 3 + [page[:300] + "X" + page[301:], "a" * 700, "ab" * 300 + "c" + "ab" * 300, "a" * 61, passage + passage, None, "", "é", "a" * 40]
    return rows


@pytest.mark.parametrize("group_bytes, piece, part", [(1 << 22, 4096, 1 << 20), (300, 50, 97)])
def test_repeats_against_brute_force(spark, monkeypatch, group_bytes, piece, part):
    monkeypatch.setattr(run_index, "PIECE", piece)
    monkeypatch.setattr(run_index, "SLICE", part)
    monkeypatch.setattr(run_index, "INDEX_BYTES", 2000)
    texts = long_texts(random.Random(7))
    docs = spark.createDataFrame([(i if i % 9 else None, t, "k", "w") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    found = run_index.without_repeats(docs, window=60, gram=20, group_bytes=group_bytes)
    rows = sorted((tuple(x) for x in found.collect()), key=repr)
    assert rows == brute_removed([(i if i % 9 else None, (t or "").encode()) for i, t in enumerate(texts)], 60)


def test_repeats_of_nothing(spark):
    assert run_index.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    one = run_index.without_repeats(spark.createDataFrame([(1, "x" * 399, "", "")], SCHEMA)).collect()
    assert [tuple(x) for x in one] == [(1, 399, 0, 0, sha256(b"x" * 399).hexdigest())]


def test_long_text_in_linear_time(spark):
    """2 MB of one letter, and 2 MB without a space that repeats a page."""
    page = random.Random(2).randbytes(2000).hex()
    docs = spark.createDataFrame([(1, "a" * 2_000_000, "", ""), (2, page * 500, "", "")], SCHEMA)
    assert {(r.doc_id, r.n_removed, r.n_spans) for r in run_index.without_repeats(docs).collect()} == {(1, 2_000_000, 1), (2, 2_000_000, 1)}


# 12 -------------------------------------------------------------------------------------------------------------


def brute_variants(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 5}
    near = defaultdict(set)
    for a in n:
        for b in n:
            if a != b and len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b))):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def misspelt(r, n):
    words = ["".join(r.choice("abcdeiourstnlé") for _ in range(r.randint(5, 9))) for _ in range(60)] + ["aaaaaaaa", "bàbàbàbà", "ÀÀÀÀÀÀ", "xyzxyz"]
    weights = [1 / (i + 1) for i in range(len(words))]

    def slip(w):
        i = r.randrange(len(w))
        return r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcdeé") + w[i:], w[:i] + r.choice("abcdeé") + w[i + 1 :], w.capitalize(), w + "s"])

    return [(i, " ".join(slip(w) if r.random() < 0.4 else w for w in r.choices(words, weights, k=400))) for i in range(n)]


def test_variants_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "HELD", 300)
    monkeypatch.setattr(spelling_variants, "STRETCH", 50)
    rows = [*misspelt(random.Random(4), 60), (None, "falter falter falter falter falter"), (7, None), (8, ""), (9, "two two"), (9, "wo1d ab×cdef ab÷cdef" * 6)]
    rows += [(10, "garlands " * 135 + "garland " * 26 + "garlan " * 5)]
    docs = spark.createDataFrame([(d, t, "k", "w") for d, t in rows], SCHEMA).repartition(3)
    found = spelling_variants.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n")
    found = sorted(tuple(x) for x in found.collect())
    assert found == brute_variants(rows)
    assert sum(f is not None for _, f, *_ in found) > 100 and any(root not in (w, form) and form for w, form, root, *_ in found)


def test_variants_of_nothing(spark):
    assert spelling_variants.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling_variants.spelling_variants(spark.createDataFrame([(1, None, "", "")], SCHEMA)).count() == 0


def test_one_edit_leaves_a_band():
    bits = {chr(c): spelling_variants.letter_bit(c) for c in [*range(97, 123), *range(0xC0, 0x100)]}
    assert len({bits[c] for c in spelling_variants.BY_FREQUENCY}) == 26 and all(0 <= b < 63 for b in bits.values())


# 13 -------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, n string, component string"


def whole(rows):
    """Rows with finite vectors, as longs."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in good]


def check_whitening(spark, rows):
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS).repartition(3)
    found = whitening.whitened(frame).collect()
    x = whole(rows)
    fit = np.array(sorted({tuple(v) for _, v in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = ((n * fit - s).astype(np.float64)) / n
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(16, int((e > 1e-9 * e[0]).sum()))
    assert Counter((r.vec_id, r.component) for r in found) == Counter((i, c + 1) for i, _ in x for c in range(k))
    dev = {(i, sum((n * a - b) ** 2 for a, b in zip(v, s))) for i, v in x}
    assert {(r.vec_id, r.deviation) for r in found} == dev and {r.n for r in found} == {n}
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-6
    for c in range(k):
        rows_c = [r for r in found if r.component == c + 1]
        assert {round(r.explained / (e[c] / e.sum()), 6) for r in rows_c} == {1.0}
        by_x = defaultdict(list)
        for i, v in x:
            by_x[i].append(((n * np.array(v, dtype=object) - s).astype(np.float64) / n) @ vectors[:, c] / math.sqrt(e[c]))
        sign = np.sign(rows_c[0].whitened * by_x[rows_c[0].vec_id][0]) if len(by_x[rows_c[0].vec_id]) == 1 else None
        got = defaultdict(list)
        for r in rows_c:
            got[r.vec_id].append(r.whitened)
        for i in by_x:
            ours = sorted(got[i]) if sign is not None and sign > 0 else sorted(-w for w in got[i])
            assert np.allclose(ours, sorted(by_x[i]), atol=1e-6)


def test_whitening_against_plain_eigenvectors(spark):
    r = random.Random(11)
    rows = [(i, [r.gauss(0, 1 + j) for j in range(20)]) for i in range(1, 300)]
    rows += [(500, None), (501, []), (502, [None] * 20), (503, [float("nan")] * 20), (504, [float("inf")] * 20), (None, rows[3][1]), (1000, rows[4][1]), (1001, [1e2] * 20)]
    check_whitening(spark, rows)


def test_whitening_of_few_rows_and_dimensions(spark):
    r = random.Random(12)
    check_whitening(spark, [(i, [r.gauss(0, 3) for _ in range(30)]) for i in range(4)])
    check_whitening(spark, [(i, [r.gauss(0, 1), r.gauss(0, 5)]) for i in range(40)])


def test_whitening_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(i, [3.0, 4.0]) for i in range(5)], [(1, None)]):
        frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)
        assert whitening.whitened(frame).collect() == []


def test_whitening_leaves_out_other_lengths(spark):
    rows = [(i, [float(i), float(i * i % 7)]) for i in range(20)] + [(99, [1.0]), (100, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)
    assert {r.vec_id for r in whitening.whitened(frame).collect()} == set(range(20))


def test_deviations_beyond_a_long(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 0.0]), (3, [0.0, 1.0])]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)
    found = whitening.whitened(frame).collect()
    assert {r.deviation for r in found if r.vec_id < 3} == {None} and len(found) == 3  # the second direction has under 1e-12 of the variance
