"""Ambiguous findings in three tiers: what the surroundings decide, what a stored judgment says, what is left to ask.

Tier 2 is an expression over a finding and the terms around it (40 characters,
within the paragraph): a sure anchor, a collocation, a veto of its domain, else
the sum of clues, a profile's preference and what the anchor adds, against two
thresholds.  Tier 3 joins what lies between with a table of judgments by a hash of
nine fields; those that have run out are none.  What no judgment answers is a
list for a judge, the most frequent questions first, up to a budget a run.

Edge cases: a finding without suggestions resolves to none; of several
collocations the first by its rank counts; a null anchor says nothing;
judgments with one key count by the latest; findings with one key are one question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..sources.zh_view import zh_docs
from .rule_scan import lexicon_rules, rules_of, scan_rules

# What decides, what is suppressed, and what evidence weighs.
DECIDED, AMBIGUOUS = 0.6, 0.3
CLUE_BASE, CLUE_SHARE, CLUE_MOST, ANCHOR = 0.3, 0.4, 0.7, 0.2
TABLES = {
    "collocations": "source string, term string, resolved string, rank int",
    "vetoes": "source string, term string",
    "priors": "source string, preferred string, weight double",
}
JUDGMENTS = "key string, chosen string, confidence double, made timestamp, expires timestamp"
#: Versions of the question and of tier 2: a judgment under another one is none.
QUESTION, SCORING = 1, 1


def _listed(table: DataFrame, *fields: str) -> DataFrame:
    return table.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("listed"))


def _around(term: Column) -> Column:
    return F.exists("near", lambda o: (o.t == term) & (o.a >= F.col("wide_low")) & (o.b <= F.col("wide_high")))


def terms_of(*tables: DataFrame) -> tuple[str, ...]:
    """The terms that tables of bounded size ask for."""
    return tuple(sorted({r.term for t in tables for r in t.select("term").distinct().toLocalIterator()}))


def scored(found: DataFrame, collocations: DataFrame, vetoes: DataFrame, priors: DataFrame) -> DataFrame:
    """``found`` (of scan_rules with windows, and a column ``anchor``) with eligible, resolution, score, and suggestions with the resolved one first."""
    rows = found.join(_listed(collocations, "rank", "term", "resolved").withColumnsRenamed({"source": "found", "listed": "pairs"}), "found", "left")
    rows = rows.join(vetoes.groupBy("source").agg(F.collect_set("term").alias("against")).withColumnRenamed("source", "found"), "found", "left")
    rows = rows.join(priors.groupBy("source").agg(F.max_by(F.struct("preferred", "weight"), "weight").alias("prior")).withColumnRenamed("source", "found"), "found", "left")
    n = F.size("suggestions")
    eligible = F.col("kind").isin("cross_strait", "confusable") & (F.coalesce("anchor", F.lit(False)) | (n > 1) | (F.size("asked") > 0) | F.col("against").isNotNull())
    rows = rows.withColumn("eligible", eligible)
    agreed = F.filter(F.coalesce("pairs", F.array().cast("array<struct<rank: int, term: string, resolved: string>>")), lambda p: _around(p.term))
    colloc = F.get(agreed, F.lit(0)).resolved
    clues = F.size(F.filter("asked", _around))
    clue = F.when(clues == 0, 0.0).otherwise(F.least(F.lit(CLUE_BASE) + CLUE_SHARE * clues / F.size("asked"), F.lit(CLUE_MOST)))
    rows = rows.withColumn("colloc", F.when(F.array_contains("suggestions", colloc), colloc)).withColumn("clue", clue).withColumn("weight", F.coalesce("prior.weight", F.lit(0.0)))
    anchored = F.when(F.coalesce("anchor", F.lit(False)) & (n > 1), ANCHOR).when(F.col("anchor") == F.lit(False), -ANCHOR).otherwise(0.0)
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.col("clue") + F.col("weight") + anchored, 9)))
    sure = F.coalesce("anchor", F.lit(False)) & (n == 1)
    vetoed = F.exists(F.coalesce("against", F.array().cast("array<string>")), _around)
    resolution = (
        F.when(sure, "anchor")
        .when(F.col("colloc").isNotNull(), "collocation")
        .when(vetoed, "suppressed")
        .when((total >= DECIDED) & (F.col("clue") >= F.col("weight")) & (F.col("clue") > 0), "clues")
        .when((total >= DECIDED) & (F.col("weight") > 0), "prior")
        .when(total >= DECIDED, "combined")
        .when(total < AMBIGUOUS, "suppressed")
        .otherwise("open")
    )
    rows = rows.withColumn("resolution", F.when(F.col("eligible"), resolution)).withColumn(
        "score", F.when(F.col("eligible"), F.when(F.col("resolution").isin("anchor", "collocation"), 1.0).when(sure | vetoed, 0.0).otherwise(total))
    )
    preferred = F.when((F.col("weight") > F.col("clue")) & F.array_contains("suggestions", F.col("prior.preferred")), F.col("prior.preferred"))
    chosen = F.when(F.col("resolution") == "collocation", F.col("colloc")).when(F.col("resolution").isin("clues", "prior", "combined"), preferred)
    return promoted(rows.withColumn("chosen", chosen), found.columns).withColumn("severity", F.when(F.col("resolution") == "suppressed", 1).otherwise(F.col("severity")))


def promoted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``suggestions`` with ``chosen`` in the first place and what stood there in its own."""
    place = F.array_position("suggestions", F.coalesce("chosen", F.lit("\0")))
    swapped = F.transform("suggestions", lambda x, i: F.when(i == 0, F.col("chosen")).when(i == place - 1, F.get("suggestions", F.lit(0))).otherwise(x))
    new = F.when(place > 1, swapped).otherwise(F.col("suggestions"))
    return rows.select(*(new.alias(c) if c == "suggestions" else c for c in columns), "eligible", "resolution", "score")


def judgment_key(context: Column, ruleset: str, profile: str, content_type: str) -> Column:
    """The hash of nine fields: rules, versions of question and scoring, profile, content type, surroundings, form, candidates, gloss."""
    bare = F.regexp_replace(context, r"\s+", "")
    middle = F.greatest(F.lit(1), F.floor(F.length(bare) / 2).cast("int") - 39)
    bare = F.when(F.length(bare) <= 80, bare).otherwise(F.substring(bare, middle, F.lit(80)))
    candidates = F.sha2(F.array_join(F.array_sort("suggestions"), "\0"), 256)
    fields = F.struct(
        F.lit(ruleset).alias("ruleset"), F.lit(QUESTION).alias("question"), F.lit(SCORING).alias("scoring"), F.lit(profile).alias("profile"), F.lit(content_type).alias("type"),
        F.concat(F.lit("v1:"), bare).alias("context"), F.col("found").alias("term"), candidates.alias("candidates"), F.coalesce("english", F.lit("")).alias("gloss"),
    )
    return F.sha2(F.to_json(fields), 256)


def judged(rows: DataFrame, judgments: DataFrame, now: Column) -> DataFrame:
    """``rows`` of scored, each open one with a column ``key``, after stored judgments: a choice goes first, a refusal suppresses."""
    live = judgments.where(F.col("expires") > now).groupBy("key").agg(F.max_by(F.struct("chosen", "confidence"), "made").alias("said"))
    found = rows.join(live, "key", "left")
    answered = (F.col("resolution") == "open") & F.col("said").isNotNull()
    kept = [c for c in rows.columns if c not in ("eligible", "resolution", "score")]
    found = found.withColumn("chosen", F.when(answered, F.col("said.chosen"))).withColumn("score", F.when(answered, F.col("said.confidence")).otherwise(F.col("score")))
    resolution = F.when(answered & F.col("chosen").isNull(), "refused").when(answered & F.array_contains("suggestions", F.col("chosen")), "judged").otherwise(F.col("resolution"))
    return promoted(found.withColumn("resolution", resolution), kept).withColumn("severity", F.when(F.col("resolution") == "refused", 1).otherwise(F.col("severity")))


def questions(rows: DataFrame, budget: int) -> DataFrame:
    """(key, found, suggestions, n): what is still open, each key once, the most frequent first; a run asks ``budget`` at most."""
    one = rows.where("resolution = 'open'").groupBy("key").agg(F.first("found").alias("found"), F.first("suggestions").alias("suggestions"), F.count("*").alias("n"))
    return one.orderBy(F.desc("n"), "key").limit(budget)


def remembered(old: DataFrame, new: DataFrame, now: Column, most: int = 10_000) -> DataFrame:
    """Judgments after ``new`` ones: the latest of each key, none that has run out, and of more than ``most`` those that last longest."""
    latest = old.unionByName(new).withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("made"), F.desc("expires"))))
    return latest.where((F.col("k") == 1) & (F.col("expires") > now)).drop("k").orderBy(F.desc("expires"), "key").limit(most)


# Queries


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    pairs = [(source, term, resolved, i) for i, (source, term, resolved) in enumerate(lx.COLLOCATIONS)]
    vetoes = [("進程", t) for t in ("歷史", "發展", "學習")]
    priors = [("文件", "檔案", 0.3), ("質量", "品質", 0.5), ("進程", "行程", 0.2)]
    return tuple(spark.createDataFrame(x, TABLES[k]) for k, x in (("collocations", pairs), ("vetoes", vetoes), ("priors", priors)))


def resolved(docs: DataFrame, rules: DataFrame, words: tuple[str, ...], tables: tuple[DataFrame, DataFrame, DataFrame], content_type: str = "plain") -> DataFrame:
    """Findings of ``docs`` (doc_id, text) after tier 2, open ones with their key and surroundings."""
    found = scan_rules(docs, rules, words, content_type, terms=terms_of(*tables[:2]), windows=True).withColumn("anchor", F.lit(None).cast("boolean"))
    return scored(found, *tables).withColumn("key", F.when(F.col("resolution") == "open", judgment_key(F.col("context"), "own", "default", content_type)))


#: In the package's vocabulary the ambiguous rules have clues of their own; here clues only weigh.
AMBIGUOUS_RULES = (
    {"source": "進程", "targets": ["行程", "程序"], "kind": "cross_strait"},
    {"source": "文件", "targets": ["檔案", "文件"], "kind": "confusable"},
    {"source": "質量", "targets": ["品質", "質量"], "kind": "confusable"},
    {"source": "程序", "targets": ["程式", "程序"], "kind": "cross_strait"},
)


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = lexicon_rules(spark).where(~F.col("source").isin(*(r["source"] for r in AMBIGUOUS_RULES)))
    rules = rules.unionByName(rules_of(spark, [{"rule_id": 1000 + i, "severity": 2, **r} for i, r in enumerate(AMBIGUOUS_RULES)]))
    return resolved(zh_docs(spark, sf_dir).withColumnRenamed("zh", "text"), rules, ("工程序列", "文件夾"), _tables(spark))


def da2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by form and how tier 2 resolved them, with the first suggestion after it."""
    rows = _all(spark, sf_dir).withColumn("first", F.get("suggestions", F.lit(0)))
    return rows.groupBy("found", "eligible", "resolution", "score", "first").agg(F.count("*").alias("n"))


def da9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most frequent questions that are left to a judge (a budget of one run)."""
    return questions(_all(spark, sf_dir), 100)


QUERIES = {"da2_tiered_resolution": da2, "da9_open_questions": da9}
