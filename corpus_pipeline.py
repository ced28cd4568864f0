"""Corpus cleaning as a chain of stages, each over all that the one before kept.

1 quality      documents that the compression classifier rejects go
2 near_copies  of each group of linked documents (five-word shingles, similarity of 0.8 or more) the smallest doc_id stays
3 benchmarks   documents that hold a benchmark item, also a re-parameterised one, go
4 secrets      secrets in texts are masked; all documents stay
5 tokens       texts become BPE ids

Each stage but the last returns the columns of documents, whatever further ones
there are.  Null and empty texts have no content that the quality classifier
could accept or reject: their score is that of its curve at 0, and they pass
stages 2 to 5 unchanged.  Of repeated rows one stays; other texts under one doc_id are
documents of their own to stages 2 and 3, and so are rows without doc_id.  An empty
table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bpe_stream import bpe_round_trip
from llm.decontaminate import contaminated
from llm.jaccard_join import jaccard_join
from llm.secrets_forest import mask_secrets
from llm.store import saved, table
from llm.zstd_quality import fit, with_score

#: The classifier rejects a document when bad text is likelier than good.
REJECT_BELOW = 0.5


#: Names of helper columns, which no table of documents has.
_SCORE, _KEY = "__pipeline_score", "__pipeline_key"


def _without(docs: DataFrame, ids: DataFrame, key: str, label: str) -> DataFrame:
    """``docs`` but for the ids in ``key``; the list is written first, so that the optimiser knows its size."""
    return docs.join(saved(ids.distinct(), label, narrow=True), key, "left_anti").select(docs.columns)


def _ids_repeat(docs: DataFrame) -> bool:
    """Whether an id occurs twice or is missing, so that rows need keys of their own."""
    return bool(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, table(spark, sf_dir, "labels"))
    return with_score(docs, model, _SCORE).where(F.col(_SCORE) >= REJECT_BELOW).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    if not _ids_repeat(docs):
        groups = jaccard_join(docs, n=5, percent=80)
        return _without(docs, groups.where("component_id != doc_id").select("doc_id"), "doc_id", "copies")
    # Ids repeat: rows get keys of their own, in the order of doc_id.
    rows = docs.dropDuplicates(["doc_id", "text"]).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = saved(rows.withColumn(_KEY, F.monotonically_increasing_id()), "keyed")
    groups = jaccard_join(rows.select(F.col(_KEY).alias("doc_id"), "text"), n=5, percent=80)
    copies = groups.where("component_id != doc_id").select(F.col("doc_id").alias(_KEY))
    return _without(rows, copies, _KEY, "copies").select(docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    if not _ids_repeat(docs):
        return _without(docs, contaminated(docs, items).select("doc_id"), "doc_id", "leaks")
    rows = saved(docs.withColumn(_KEY, F.monotonically_increasing_id()), "keyed")
    leaks = contaminated(rows.select(F.col(_KEY).alias("doc_id"), "text"), items).select(F.col("doc_id").alias(_KEY))
    return _without(rows, leaks, _KEY, "leaks").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES = [("quality", quality), ("near_copies", near_copies), ("benchmarks", benchmarks), ("secrets", secrets), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
