"""Structure of texts as rows: blocks, headings, cells, masks; and detectors on what the masks leave.

A text is parsed once, in Arrow batches next to the scan; what comes out is
narrow rows, or the text itself with MASKED for what its content type leaves
alone.  Detectors then read that text, so one mask holds for all of them and no
finding meets a mask by a join.

Edge cases: a null or empty text has no rows; repeated and null ids keep their
rows; MASKED itself in a text counts as masked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dialect import SPARK
from ..functions import blocks, spans
from ..functions.quotes import quotes
from ..plans.registered import _doubles
from ..sources.store import written
from ..sources.zh_view import zh_docs
from . import passages
from .shapes import SHAPES, found_in

_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def rows_of(docs: DataFrame, schema: str, make: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """doc_id and the rows that ``make`` gives for each text of ``docs`` (doc_id, text); ``schema`` is of these rows."""
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for row in make(text) if text else ():
                    ids.append(doc)
                    rows.append(row)
            columns = [pa.array([r[i] for r in rows], _TYPES[kind]) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], ["doc_id", *(name for name, _ in fields)])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, f"doc_id long, {schema}")


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, ord, kind, level, depth, start, finish of each block, containers too."""
    return rows_of(docs, "ord int, kind string, level int, depth int, start int, finish int", lambda t: [(i, b.kind, b.level, b.depth, b.start, b.end) for i, b in enumerate(blocks.blocks(t))])


def section_starts(docs: DataFrame) -> DataFrame:
    """doc_id, start of each line that ends the section before it."""
    return rows_of(docs, "start int", lambda t: [(a,) for a in blocks.section_starts(t)])


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, level, start, finish, title: the prose of each heading, of either form."""

    def make(text: str) -> list[tuple]:
        found = [(b.level, b.prose[0][0], b.prose[-1][1]) for b in blocks.blocks(text) if b.kind == "heading"]
        return [(level, a, b, text[a:b]) for level, a, b in found if a < b]

    return rows_of(docs, "level int, start int, finish int, title string", make)


def table_cells(docs: DataFrame) -> DataFrame:
    """doc_id, tab (table of the text), line, col, start, finish, cell; the header is line 0."""

    def make(text: str) -> list[tuple]:
        tables = [b for b in blocks.blocks(text) if b.kind == "table"]
        return [(i, row, col, a, b, text[a:b]) for i, t in enumerate(tables) for row, col, a, b in t.cells]

    return rows_of(docs, "tab int, line int, col int, start int, finish int, cell string", make)


def masks(docs: DataFrame, content_type: str = "plain") -> DataFrame:
    """doc_id, start, finish of each masked span."""
    return rows_of(docs, "start int, finish int", lambda t: spans.mask_of(t, content_type))


def visible(docs: DataFrame, content_type: str = "plain") -> DataFrame:
    """doc_id, text with MASKED for what the content type leaves alone; a row for each row of ``docs``, null texts as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and spans.visible(t, content_type) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, text string")


def detected(docs: DataFrame, content_type: str = "plain", names: Iterable[str] = SHAPES) -> DataFrame:
    """doc_id, detector, start, found, suggestion, kind, severity: findings of detectors in texts of a content type."""
    names = list(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for row in found_in(spans.visible(text, content_type), names, True) if text else ():
                    ids.append(doc)
                    rows.append(row)
                if len(rows) > 65536:
                    yield _detected(ids, rows)
                    ids, rows = [], []
            yield _detected(ids, rows)

    found = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, detector string, start long, found string, suggestion string, kind string, severity int")
    # Of a detector of several shapes equal findings count once, whatever row they are of; those of others stay apart.
    several = [n for n in names if isinstance(SHAPES[n][0], tuple)]
    if not several:
        return found
    apart = F.when(F.col("detector").isin(several), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1)
    return found.withColumn("apart", apart).distinct().drop("apart")


def _detected(ids: list[int | None], rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], "doc_id detector start found suggestion kind severity".split())


def passages_detected(docs: DataFrame, content_type: str = "plain", names: Iterable[str] = passages.DETECTORS) -> DataFrame:
    """doc_id, detector, start, found, n, kind, severity, family: findings over sentences, paragraphs and lines of a content type."""
    names = list(names)
    seen = visible(docs, content_type).withColumnRenamed("text", "zh")
    seen = written(seen, "seen") if len(names) > 1 else seen
    view = "ink_passages_" + hashlib.sha256(f"{id(seen)}".encode()).hexdigest()[:12]
    seen.createOrReplaceTempView(view)
    each = [f"SELECT doc_id, '{n}' AS detector, start, found, n, kind, severity, family FROM ({passages.DETECTORS[n](SPARK, view)})" for n in names]
    return docs.sparkSession.sql(_doubles(" UNION ALL ".join(each)))


def quote_faults(docs: DataFrame, content_type: str = "plain") -> DataFrame:
    """doc_id, start, found, suggestion, fault of quotation marks and brackets."""
    return rows_of(docs, "start int, found string, suggestion string, fault string", lambda t: quotes(t, spans.mask_of(t, content_type)))


def ort6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation marks that become brackets, by depth, and brackets that don't nest."""
    return quote_faults(_zh(spark, sf_dir))


def _zh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zh_docs(spark, sf_dir).withColumnRenamed("zh", "text")


def exc6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the texts read as Markdown."""
    return markdown_blocks(_zh(spark, sf_dir))


def exc7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines at which a section of a text ends."""
    return section_starts(_zh(spark, sf_dir))


def exc8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with the places of their prose."""
    return headings(_zh(spark, sf_dir))


def exc9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tables with their places."""
    return table_cells(_zh(spark, sf_dir))


def exc18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each content type leaves alone, by text: spans and characters."""
    out = None
    for kind in ("plain", "markdown", "markdown_code", "yaml", "json"):
        found = masks(_zh(spark, sf_dir), kind).groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.col("finish") - F.col("start")).alias("chars"))
        found = found.withColumn("content_type", F.lit(kind))
        out = found if out is None else out.unionByName(found)
    return out


#: Detectors of each kind; the rest is as quick to ask for.
DETECTED = ("ort1_halfwidth_marks", "ort3_colon", "ort10_ellipsis", "grm5_nominalised_verb", "ai18_negative_parallel", "tr7_de_chain", "tr11_connectives")


def exc18_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of seven detectors in the texts read as Markdown."""
    return detected(_zh(spark, sf_dir), "markdown", DETECTED)


def exc13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of event properties that a JSON mask leaves to be read."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS doc_id", "props AS text")
    held = masks(events, "json").groupBy("doc_id").agg(F.sum(F.col("finish") - F.col("start")).alias("held"))
    return events.select(F.col("doc_id").alias("event_id"), F.length("text").alias("n_chars"), "doc_id").join(held, "doc_id", "left").selectExpr("event_id", "cast(n_chars - coalesce(held, 0) AS bigint) AS visible")


QUERIES = {
    "exc6_markdown_blocks": exc6, "exc7_section_starts": exc7, "exc8_heading_places": exc8, "exc9_cell_places": exc9, "exc18_content_masks": exc18, "exc18_masked_findings": exc18_found, "exc13_json_values": exc13,
    "ort6_quote_faults": ort6,
}
#: Properties hold one key and a number, so no character of a string value.
ORACLE_SQL = {"exc13_json_values": "SELECT event_id, CAST(0 AS BIGINT) AS visible FROM events"}
