"""Conversion by dictionaries: each stage a table of forms and what they become.

A stage replaces, from left to right, the longest form of its table that begins
at a place; the next stage reads what it wrote (phrases and characters first, then regional forms).
What a mask of the content type covers stays: code, URLs, keys, escapes and
placeholders; of JSON only string values are converted, over the bytes as they are
written, so nothing is decoded or encoded anew.

A stage's forms are held in each task; a table of more than FORM_BYTES is an
error, as a dictionary is not a corpus.

Edge cases: null and empty texts stay; of forms given twice the smallest target
counts; a null or empty form is none; an identity keeps its form from shorter ones;
JSON whose string does not close is read as plain text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.spans import mask_of, merged
from ..sources.zh_view import zh_docs
from .rule_scan import longest

FORM_BYTES = 32 << 20


class Dictionary:
    """Forms of one stage and their targets."""

    def __init__(self, forms: dict[str, str]) -> None:
        self.forms = forms
        if sum(len(a) + len(b) for a, b in forms.items()) * 3 > FORM_BYTES:
            raise ValueError(f"a stage's dictionary has more than {FORM_BYTES} bytes")

    @lru_cache(maxsize=1)  # noqa: B019  (one object a task)
    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for form in self.forms:
            a.add_word(form, form)
        a.make_automaton()
        return a if len(a) else None

    def apply(self, text: str) -> tuple[str, int]:
        """The converted text, and how many places changed."""
        if self.automaton() is None:
            return text, 0
        parts, at, changed = [], 0, 0
        for a, b, form in longest([(end + 1 - len(form), end + 1, form) for end, form in self.automaton().iter(text)]):
            to = self.forms[form]
            parts += [text[at:a], to]
            at, changed = b, changed + (to != form)
        return "".join([*parts, text[at:]]), changed


def dictionary(table: DataFrame) -> Dictionary:
    """A stage from a table (source, target) of bounded size."""
    rows = table.where("source IS NOT NULL AND source <> '' AND target IS NOT NULL").groupBy("source").agg(F.min("target").alias("target"))
    return Dictionary({r.source: r.target for r in rows.toLocalIterator()})


def converted(text: str, stages: list[Dictionary], content_type: str) -> tuple[str, int]:
    """A text with what its mask leaves converted; no form reaches over a mask."""
    mask = merged(mask_of(text, content_type))
    out, at, total = [], 0, 0
    for a, b in [*mask, (len(text), len(text))]:
        piece = text[at:a]
        for stage in stages:
            piece, n = stage.apply(piece)
            total += n
        out += [piece, text[a:b]]
        at = b
    return "".join(out), total


def convert(docs: DataFrame, stages: list[DataFrame], content_type: str = "plain") -> DataFrame:
    """doc_id, text, changed for each row of ``docs`` (doc_id, text)."""
    held = [dictionary(s) for s in stages]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [converted(t, held, content_type) if t else (t, 0) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], ["doc_id", "text", "changed"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, text string, changed int")


def script_shares(docs: DataFrame, characters: DataFrame) -> DataFrame:
    """doc_id, simplified, traditional: how many characters of each text only one script has, by a table of pairs."""
    pairs = characters.where("source <> target AND length(source) = 1 AND length(target) = 1").select(F.explode(F.array(F.struct(F.col("source").alias("c"), F.lit(1).alias("s")), F.struct(F.col("target").alias("c"), F.lit(0).alias("s")))).alias("p")).select("p.c", "p.s")
    own = pairs.groupBy("c").agg(F.min("s").alias("s"), F.max("s").alias("m")).where("s = m").select("c", "s")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # Characters are counted in the row before they are joined.
    chars = texts.select("row", "doc_id", F.explode_outer(F.split(F.coalesce("text", F.lit("")), "")).alias("c")).groupBy("row", "doc_id", "c").agg(F.count("*").alias("n"))
    return chars.join(own, "c", "left").groupBy("row", "doc_id").agg(F.sum(F.when(F.col("s") == 1, F.col("n")).otherwise(0)).alias("simplified"), F.sum(F.when(F.col("s") == 0, F.col("n")).otherwise(0)).alias("traditional")).drop("row")


# Queries

PHRASES = (("软件", "軟件"), ("数据", "數據"), ("质量", "質量"), ("优化", "優化"))
REGIONAL = (("軟件", "軟體"), ("數據", "資料"), ("數據機", "數據機"), ("質量", "品質"), ("網絡", "網路"), ("服務器", "伺服器"), ("用戶", "使用者"))


def own_stages(spark: SparkSession) -> list[DataFrame]:
    """Phrases over characters, then regional forms."""
    first = [*PHRASES, *((a, b) for a, b in zip(lx.SIMPLIFIED, lx.TRADITIONAL) if a != b)]
    return [spark.createDataFrame(list(x), "source string, target string") for x in (first, REGIONAL)]


def pre7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts converted in two stages outside URLs and mentions: places changed, length and digest."""
    docs = zh_docs(spark, sf_dir).withColumnRenamed("zh", "text")
    return convert(docs, own_stages(spark)).select("doc_id", "changed", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


def pre8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as values of JSON, converted in place: the key stays, and what is read back is the converted value."""
    docs = zh_docs(spark, sf_dir).selectExpr("doc_id", "to_json(named_struct('軟件', zh)) AS text")
    read = convert(docs, own_stages(spark), "json").select("doc_id", "changed", F.get_json_object("text", "$.軟件").alias("value"))
    return read.select("doc_id", "changed", F.length("value").alias("n_chars"), F.sha2("value", 256).alias("digest"))


def pre9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is converted by itself: more characters of the simplified script than of the other."""
    docs = zh_docs(spark, sf_dir).withColumnRenamed("zh", "text")
    return script_shares(docs, own_stages(spark)[0]).withColumn("converts", F.col("simplified") > F.col("traditional"))


QUERIES = {"pre7_staged_conversion": pre7, "pre8_json_conversion": pre8, "pre9_script_gate": pre9}
_S = "".join(a for a, b in zip(lx.SIMPLIFIED, lx.TRADITIONAL) if a != b)
_T = "".join(b for a, b in zip(lx.SIMPLIFIED, lx.TRADITIONAL) if a != b)
PRE9_SQL = f"""SELECT doc_id, s::BIGINT AS simplified, t::BIGINT AS traditional, s > t AS converts FROM (
  SELECT doc_id, length(zh) - length(translate(zh, '{_S}', '')) AS s, length(zh) - length(translate(zh, '{_T}', '')) AS t FROM zh)"""
