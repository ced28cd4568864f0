"""Spelling variants of a corpus's words, by bands of letter-parity masks.

A word's mask has a bit for each letter: whether the letter occurs an odd number
of times.  One inserted or deleted letter flips one bit, one replaced letter two
at most, so of three bands of the mask at least one stays equal.  Words meet in
the groups of equal (band, value, length), a longer word also in those of the
length below.  The half of the word before or behind the edit stays equal too,
and splits the groups further, so that a group holds words that differ in half
of their letters at most.  A pair is made in the first group that both share, when its
masks differ by two bits at most and its edit distance is one.

Only the vocabulary is joined: words are counted before, with sums in each task.

Letters are dealt to the bands by their frequency, so that each band splits well;
accented letters share bits, which keeps the bound of two flips.

Edge cases: a null text has no words; a null doc_id counts as an empty one in the
checksum's input; repeated rows count again; of equally frequent near words the
first in code-point order is the form; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import release, saved, table

#: Fixed values of the task: letters, slips, and what makes a word and a form.
RUN = r"[A-Za-zÀ-ÿ]+"
SLIP, LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 199, 6, 5, 5

#: Letters of European languages, the most frequent first.
BY_FREQUENCY = "etaoinsrhldcumfpgwybvkxjqz"
BANDS, BAND_BITS = 3, 21
#: Words that a task counts before it passes them on; characters of a text that are split at a time.
HELD, STRETCH = 200_000, 1 << 20


def letter_bit(code: int) -> int:
    """The bit of a letter, in its band."""
    rank = BY_FREQUENCY.find(chr(code))
    if rank >= 0:
        return rank % BANDS * BAND_BITS + rank // BANDS
    own = -(-len(BY_FREQUENCY) // BANDS)
    return code % BANDS * BAND_BITS + own + code // BANDS % (BAND_BITS - own)


def _stretches(text: str, gap: re.Pattern) -> Iterator[str]:
    """``text`` in parts that end between runs."""
    at = 0
    while len(text) - at > STRETCH and (cut := gap.search(text, at + STRETCH)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run, gap, totals = re.compile(RUN), re.compile(r"[^A-Za-zÀ-ÿ]"), Counter()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64())], ["word", "n"])

    for rows in batches:
        for name, text in zip(rows.column("doc_id").to_pylist(), rows.column("bytes").to_pylist()):
            prefix = zlib.crc32(f"{'' if name is None else name}:".encode())
            # bytes.lower changes A-Z alone.
            seen = Counter()
            for part in _stretches(text.lower().decode(errors="replace"), gap):
                seen.update(run.findall(part))
            for word, n in seen.items():
                h = zlib.crc32(word.encode(), prefix)
                if h % SLIP == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                if len(word) >= LEAST_LENGTH:
                    totals[word] += n
            if len(totals) >= HELD:
                yield batch()
                totals.clear()
    if totals:
        yield batch()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text) after slips."""
    rows = docs.where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("bytes"))
    counts = rows.mapInArrow(_counts, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _mask(word: Column) -> Column:
    """Letter parities of a word, as a long of three bands."""
    bits = F.create_map(*(F.lit(x) for c in [*map(ord, BY_FREQUENCY), *range(0xC0, 0x100)] for x in (chr(c), 1 << letter_bit(c))))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, c: mask.bitwiseXOR(F.coalesce(bits[c], F.lit(0)).cast("long")))


def _groups(words: DataFrame, longer: bool) -> DataFrame:
    """A row for each group of a word: its band and value, the length of the group, and the half that it is split by.

    ``longer``: the groups in which a word is sought among words of one letter less.
    """
    size = F.length("word") - int(longer)
    half = F.floor(size / 2).cast("int")
    head = F.substring("word", F.lit(1), half)
    # The last letters of a group's shorter words, as many as they have behind the half.
    tail = F.right(F.col("word"), size - half)
    shift = [F.shiftright("mask", BAND_BITS * b).bitwiseAND(F.lit((1 << BAND_BITS) - 1)) for b in range(BANDS)]
    keys = [F.struct(F.lit(b).alias("band"), shift[b].alias("value"), F.lit(i).alias("side"), x.alias("part")) for b in range(BANDS) for i, x in enumerate((head, tail))]
    return words.select("word", "n", "mask", size.alias("size"), head.alias("head"), F.explode(F.array(*keys)).alias("g")).select("word", "n", "mask", "size", "head", "g.*")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of near words once, ``a`` the shorter or, of one length, the smaller word."""
    words = words.withColumn("mask", _mask(F.col("word")))
    shorter = _groups(words, False).withColumnsRenamed({"word": "a", "n": "a_n", "mask": "a_mask", "head": "a_head"})
    others = _groups(words, False).withColumn("same", F.lit(True)).unionByName(_groups(words, True).withColumn("same", F.lit(False)))
    others = others.withColumnsRenamed({"word": "b", "n": "b_n", "mask": "b_mask", "head": "b_head"})
    flips = F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    equal = [flips.bitwiseAND(F.lit(((1 << BAND_BITS) - 1) << BAND_BITS * b)) == 0 for b in range(BANDS)]
    first_band = F.when(equal[0], 0).when(equal[1], 1).otherwise(2)
    once = (F.col("band") == first_band) & ((F.col("side") == 0) | (F.col("a_head") != F.col("b_head")))
    near = (F.bit_count(flips) <= 2) & (F.levenshtein("a", "b", 1) == 1)
    # Words of one length meet in both orders; a longer word meets the shorter ones alone.
    pairs = shorter.join(others, ["band", "value", "side", "part", "size"]).where((~F.col("same") | (F.col("a") < F.col("b"))) & once & near)
    return pairs.select("a", "a_n", "b", "b_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by doubling steps; counts grow by FORM_RATIO a step, so there are few."""
    at = saved(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        next_ = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        found = saved(at.join(next_, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "steps")
        release(at)
        at = found.select("word", "root")
        at.saved_at = found.saved_at
        if not found.where("moved").limit(1).count():
            return at


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``docs`` (doc_id, text)."""
    words = saved(vocabulary(docs), "words")
    pairs = saved(near_pairs(words), "pairs")
    sides = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("form")).alias("best"))
    sides = sides.unionByName(pairs.select(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("m"), F.col("a").alias("form")).alias("best")))
    near = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    near = words.join(near, "word", "left").withColumn("has", F.coalesce(-F.col("best.m") >= FORM_RATIO * F.col("n"), F.lit(False)))
    found = saved(
        near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best.form")).alias("form"), F.when(F.col("has"), -F.col("best.m")).alias("form_n")),
        "forms",
    )
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: Near words share what is left without one letter at one place, or one is what is left of the other.
OP12_SQL = """
WITH RECURSIVE codes AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS code
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (
  SELECT run, count(*) AS n,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(doc_id::VARCHAR, '') || ':' || run), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(any_value(code)[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS h
  FROM runs, codes GROUP BY doc_id, run
), slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM counted
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, (SELECT min(x.other) FROM near x WHERE x.word = w.word AND x.other_n = b.most) AS form, b.most AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.most >= 5 * w.n
), counts AS (
  SELECT f.word, f.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form, f.form_n FROM forms f LEFT JOIN best b ON b.word = f.word
), chain AS (
  SELECT word, coalesce(form, word) AS root FROM counts
  UNION SELECT c.word, f.form FROM chain c JOIN counts f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT c.word, c.form, (SELECT min(r.root) FROM chain r JOIN counts t ON t.word = r.root WHERE r.word = c.word AND t.form IS NULL) AS root, c.n, c.n_near, c.form_n::BIGINT AS form_n
FROM counts c
"""
