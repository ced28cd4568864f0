"""DataFrame functions: scan, fix, convert, score.

The sequential parts run in Arrow batches next to the texts, so no text is
shuffled; findings come out as rows and all policies and reports are joins and
aggregations on them.  The same functions take a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import prose, spans

ISSUES = "doc_id long, start int, length int, byte_start int, line int, col int, found string, suggestions array<string>, kind string, severity int, pass string"
FIXED = "doc_id long, text string, applied int, skipped int, declined int"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _scanned(content_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not raw:
                    continue
                text, places = prose.normalised(raw)
                at = lambda i, places=places: places[i] if places else i
                line, head, bytes_at, seen = 1, 0, 0, 0
                for start, length, _, suggestions, kind, severity, name, _ in prose.resolved(prose.found(text, content_type)):
                    a, b = at(start), at(start + length)
                    # Findings are in order, so lines and bytes are counted once over the text.
                    line += raw.count("\n", seen, a)
                    head = raw.rfind("\n", 0, a) + 1
                    bytes_at += len(raw[seen:a].encode())
                    seen = a
                    col = 1 + len(raw[head:a].encode("utf-16-le")) // 2
                    rows.append((doc, a, b - a, bytes_at, line, col, raw[a:b], suggestions, kind, severity, name))
            yield _batch(rows, ISSUES)

    return run


def scan(docs: DataFrame, content_type: str = "plain") -> DataFrame:
    """Findings of each document (doc_id, text): disjoint, by place; a null or empty text has none."""
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(_scanned(content_type), ISSUES)


def _fixed(content_type: str, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                total = (0, 0, 0)
                for _ in range(rounds if text else 0):
                    text, *counts = prose.applied(text, prose.resolved(prose.found(text, content_type)))
                    total = (total[0] + counts[0], counts[1], counts[2])
                    if not counts[0]:
                        break
                rows.append((doc, text, *total))
            yield _batch(rows, FIXED)

    return run


def fix(docs: DataFrame, content_type: str = "plain", rounds: int = 1) -> DataFrame:
    """Texts with the safe fixes of up to ``rounds`` scans, and what was applied, skipped and declined."""
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(_fixed(content_type, rounds), FIXED)


def convert(docs: DataFrame) -> DataFrame:
    """Simplified to Traditional, then up to three rounds of fixes."""
    from .operators.lexical import converted

    return fix(docs.withColumn("text", F.expr(converted("text"))), rounds=3)


def score(docs: DataFrame) -> DataFrame:
    """Findings per 1,000 characters by document and kind."""
    counts = scan(docs).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.max("severity").alias("severity"))
    return counts.join(docs.select("doc_id", F.length("text").alias("chars")), "doc_id").withColumn("per_1000", F.round(F.col("n") * 1000 / F.col("chars"), 6))


def words(docs: DataFrame) -> DataFrame:
    """Words of each document (doc_id, text): place, word, whether the dictionary has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, i, w, int(k)) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for i, w, k in prose.segmented(t or "")]
            yield _batch(rows, "doc_id long, start int, word string, known int")

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, start int, word string, known int")


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n, known for each document that has words: how many, and how many the dictionary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(d, *prose.word_counts(t)) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if t], "doc_id long, n long, known long")

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, n long, known long")


def masks(docs: DataFrame, content_type: str = "plain") -> DataFrame:
    """Spans that are left alone (doc_id, start, finish)."""
    mask = spans.html_lang_mask if content_type == "html" else lambda t: spans.mask_of(t, content_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, a, b) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for a, b in mask(t or "")]
            yield _batch(rows, "doc_id long, start int, finish int")

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, start int, finish int")


def edit_scores(rows: DataFrame) -> DataFrame:
    """doc_id, found, wanted, both, precision, recall, f1 of corrections (doc_id, text, expected, got); a rate without a divisor is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(*(batch.column(c).to_pylist() for c in ("text", "expected", "got")))
            yield _batch([(d, *prose.edit_score(*(x or "" for x in t))) for d, t in zip(batch.column("doc_id").to_pylist(), texts)], "doc_id long, found long, wanted long, both long")

    counts = rows.selectExpr("cast(doc_id AS long) AS doc_id", "text", "expected", "got").mapInArrow(run, "doc_id long, found long, wanted long, both long")
    rates = counts.withColumn("precision", F.expr("round(both / nullif(found, 0), 6)")).withColumn("recall", F.expr("round(both / nullif(wanted, 0), 6)"))
    return rates.withColumn("f1", F.expr("round(2 * both / nullif(found + wanted, 0), 6)"))
