"""Fixes by tier, the list of what was written, and judgments carried over a second scan.

Whether a finding is written is an expression over its row (``verdict``).  Findings
meet their texts once, by a hash of the text, and are spliced in Arrow batches; a
finding that doesn't stand where it says is dropped, so a shared hash can't write into another text.
Places before and after fixes are sums over the list of fixes, so what a later
scan finds joins with what an earlier one knew by place, form and gloss.

Tiers: ``none``, ``orthographic`` (marks, spacing, casing, variants, invisible
characters), ``lexical_safe`` (terms without clues), ``lexical_contextual`` (terms
whose clues stand in the window: two for confusable ones).

Edge cases: null and empty texts come out as they are; repeated rows are fixed
alike, whatever their ids; nothing is written over a mask; in JSON no
suggestion with a quote mark, backslash or control character is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prose import resolved
from ..sources.zh_view import zh_docs
from .rule_scan import lexicon_rules, scan_rules
from .structure import detected

TIERS = ("none", "orthographic", "lexical_safe", "lexical_contextual")
#: Kinds that need no knowledge of words.
ORTHOGRAPHIC = ("punctuation", "spacing", "case", "variant")
#: Detectors whose suggestions are mechanical.
MECHANICAL = tuple("ort1_halfwidth_marks ort2_parentheses ort3_colon ort10_ellipsis ort11_fullwidth_digits ort11_repeated_fullwidth_mark ort11_space_by_fullwidth_mark ort14_spaced_acronym".split())
FINDINGS = "doc_id long, start int, finish int, found string, kind string, severity int, english string, suggestions array<string>, clues int, gated boolean, confidence string, anchor boolean, judged string, advisory boolean"
FIXES = "array<struct<start: int, old: int, replacement: string>>"

_INVISIBLE, _JUNK = "^[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]+$", "^[\\x{200B}\\x{FEFF}]+$"


def verdict(tier: str) -> Column:
    """``apply``, ``skip`` (none of this tier's business) or ``decline`` (weighed, and left to a person) for a row of FINDINGS."""
    level = TIERS.index(tier)
    sized = F.size("suggestions")
    deletes = (F.col("kind") == "ai_style") & (sized == 1) & (F.get("suggestions", F.lit(0)) == "") & F.col("found").rlike(_INVISIBLE)
    # Joiners may be part of a spelling; a mark at the beginning of a file is not in it.
    junk = deletes & F.col("found").rlike(_JUNK) & ((F.col("start") > 0) | ~F.contains("found", F.lit("﻿")))
    mechanical = F.col("kind").isin(*ORTHOGRAPHIC) | junk
    needed = F.when(F.col("kind") == "confusable", 2).otherwise(1)
    return (
        F.when(F.lit(level == 0), "skip")
        .when(deletes & ~junk, "decline")
        .when(F.coalesce("advisory", F.lit(False)), "skip")
        .when(F.lit(level == 1) & ~mechanical, "skip")
        .when(~mechanical & (F.coalesce("judged", F.lit("")) == "suppressed"), "decline")
        .when(~mechanical & F.lit(level < 3) & F.col("gated"), "skip")
        .when(~mechanical & F.lit(level < 3) & (F.coalesce("confidence", F.lit("")) == "low"), "decline")
        .when(~mechanical & ~F.col("gated") & ~F.coalesce("anchor", F.lit(True)), "decline")
        .when(~mechanical & F.col("gated") & (F.col("clues") < needed), "decline")
        .when(sized == 1, "apply")
        .when(sized > 1, "decline")
        .otherwise("skip")
    )


def admitted(content_type: str) -> Column:
    """Whether what a finding suggests may stand in a text of the type."""
    return F.lit(True) if content_type != "json" else ~F.exists("suggestions", lambda s: s.rlike('["\\\\\\x00-\\x1f]'))


def spliced(text: str, findings: list[dict]) -> tuple[str, int, int, int, list[dict]]:
    """(text, applied, skipped, declined, fixes) of findings with verdicts, in order of place; skipped ones hold the declined."""
    parts, at, barrier, declined, fixes = [], 0, 0, 0, []
    for f in findings:
        a, b = f["start"], f["finish"]
        # Of overlapping rewritings of grammar the outer one decides.
        if a < at or f["kind"] == "grammar" and a < barrier:
            continue
        if f["verdict"] == "decline":
            declined += 1
            barrier = max(barrier, b)
        elif f["verdict"] == "apply":
            to = f["suggestions"][0]
            parts += [text[at:a], to]
            at = b
            fixes.append({"start": a, "old": b - a, "replacement": to})
    return "".join([*parts, text[at:]]), len(fixes), len(findings) - len(fixes), declined, fixes


def _disjoint(text: str, findings: list[dict]) -> list[dict]:
    """Findings that stand in the text; of overlapping ones the longest, most severe, first, but for grammar, which may overlap."""
    real = [f for f in findings if text[f["start"] : f["start"] + len(f["found"])] == f["found"]]
    grammar = [f for f in real if f["kind"] == "grammar"]
    rows = [(f["start"], f["finish"] - f["start"], f["found"], f["suggestions"], f["kind"], f["severity"], "", i) for i, f in enumerate(real) if f["kind"] != "grammar"]
    return sorted([real[r[-1]] for r in resolved(rows)] + grammar, key=lambda f: (f["start"], -f["finish"]))


def _fix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = [], []
        for doc, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "found"))):
            ids.append(doc)
            out.append(spliced(text, _disjoint(text, found)) if text and found else (text, 0, 0, 0, []))
        fixes = pa.list_(pa.struct([("start", pa.int32()), ("old", pa.int32()), ("replacement", pa.string())]))
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32(), fixes))]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], ["doc_id", "text", "applied", "skipped", "declined", "fixes"])


def findings_of(docs: DataFrame, rules: DataFrame, words: tuple[str, ...] = (), content_type: str = "plain", detectors: tuple[str, ...] = MECHANICAL) -> DataFrame:
    """FINDINGS of rules and detectors in ``docs`` (doc_id, text)."""
    terms = scan_rules(docs, rules, words, content_type)
    out = terms.selectExpr("doc_id", "start", "finish", "found", "kind", "severity", "english", "suggestions", "clues", "gated", "confidence", "cast(null as boolean) AS anchor", "cast(null as string) AS judged", "false AS advisory")
    if detectors:
        marks = detected(docs, content_type, detectors).selectExpr(
            "doc_id", "cast(start as int) AS start", "cast(start + length(found) as int) AS finish", "found", "kind", "severity", "cast(null as string) AS english",
            "CASE WHEN suggestion IS NULL THEN cast(array() as array<string>) ELSE array(suggestion) END AS suggestions", "0 AS clues", "false AS gated", "cast(null as string) AS confidence",
            "cast(null as boolean) AS anchor", "cast(null as string) AS judged", "false AS advisory",
        )
        out = out.unionByName(marks)
    return out


def apply_fixes(docs: DataFrame, findings: DataFrame, tier: str, content_type: str = "plain") -> DataFrame:
    """doc_id, text, applied, skipped, declined, fixes for each row of ``docs`` (doc_id, text); FINDINGS name a text by its xxhash64."""
    weighed = findings.where(admitted(content_type)).withColumn("verdict", verdict(tier))
    by_text = weighed.groupBy(F.col("doc_id").alias("key")).agg(F.array_distinct(F.collect_list(F.struct("start", "finish", "found", "kind", "severity", "suggestions", "verdict"))).alias("found"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key")).join(by_text, "key", "left")
    return rows.select("doc_id", "text", "found").mapInArrow(_fix_rows, f"doc_id long, text string, applied int, skipped int, declined int, fixes {FIXES}")


def keyed(docs: DataFrame) -> DataFrame:
    """Each text once in a task at least, named by its hash."""
    return docs.where("text IS NOT NULL AND text <> ''").select(F.xxhash64("text").alias("doc_id"), "text")


def fix(docs: DataFrame, rules: DataFrame, tier: str = "lexical_safe", words: tuple[str, ...] = (), content_type: str = "plain", detectors: tuple[str, ...] = MECHANICAL) -> DataFrame:
    """Texts with the fixes of a tier, counts, and the list of fixes."""
    return apply_fixes(docs, findings_of(keyed(docs), rules, words, content_type, detectors), tier, content_type)


def moved(place: Column, fixes: Column) -> Column:
    """Where a place of the text before fixes stands after them."""
    gained = lambda total, f: total + F.when(f.start < place, F.length(f.replacement) - f.old).otherwise(0)
    return (place + F.aggregate(fixes, F.lit(0), gained)).cast("int")


def written(fixes: Column) -> Column:
    """The spans that fixes cover in the text they made, as an array of (a, b)."""
    step = lambda state, f: F.struct(
        (state.gained + F.length(f.replacement) - f.old).alias("gained"), F.array_append(state.spans, F.struct((f.start + state.gained).alias("a"), (f.start + state.gained + F.length(f.replacement)).alias("b"))).alias("spans")
    )
    start = F.struct(F.lit(0).alias("gained"), F.array().cast("array<struct<a: int, b: int>>").alias("spans"))
    return F.aggregate(fixes, start, step, lambda s: s.spans)


def unsettled(later: DataFrame, fixed: DataFrame) -> DataFrame:
    """Findings of the fixed texts but for those that touch what a fix wrote; both by doc_id."""
    spans = fixed.select("doc_id", F.explode(written(F.col("fixes"))).alias("w")).select("doc_id", "w.a", "w.b")
    touch = (F.col("l.start") < F.col("w.b")) & (F.col("l.finish") > F.col("w.a")) | (F.col("w.a") == F.col("w.b")) & (F.col("l.start") <= F.col("w.a")) & (F.col("l.finish") > F.col("w.a"))
    return later.alias("l").join(spans.alias("w"), (F.col("l.doc_id") == F.col("w.doc_id")) & touch, "left_anti")


def carried(later: DataFrame, earlier: DataFrame, fixed: DataFrame) -> DataFrame:
    """Findings of a second scan with the severity, anchor and suggestions that the first scan's ones had been given.

    They are the same if their place, length, form and gloss are; rows go by doc_id.
    """
    kept = earlier.join(fixed.select("doc_id", "fixes"), "doc_id").select(
        "doc_id", moved(F.col("start"), F.col("fixes")).alias("start"), (F.col("finish") - F.col("start")).alias("size"), "found", F.coalesce("english", F.lit("")).alias("gloss"),
        F.struct("severity", "anchor", "judged", "suggestions").alias("known"),
    )
    kept = kept.groupBy("doc_id", "start", "size", "found", "gloss").agg(F.min("known").alias("known"))
    rows = later.withColumn("size", F.col("finish") - F.col("start")).withColumn("gloss", F.coalesce("english", F.lit("")))
    rows = rows.join(kept, ["doc_id", "start", "size", "found", "gloss"], "left")
    restored = {c: F.when(F.col("known").isNotNull(), F.col(f"known.{c}")).otherwise(F.col(c)) for c in ("severity", "anchor", "judged", "suggestions")}
    return rows.select(*(restored[c].alias(c) if c in restored else c for c in later.columns))


# Queries

WORDS = ("應用程序", "工程序列", "用戶端", "文件夾")


def _fixed(spark: SparkSession, sf_dir: str, tier: str) -> DataFrame:
    return fix(zh_docs(spark, sf_dir).withColumnRenamed("zh", "text"), lexicon_rules(spark), tier, WORDS)


def fx1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of each tier on all findings, by kind."""
    found = findings_of(keyed(zh_docs(spark, sf_dir).withColumnRenamed("zh", "text")), lexicon_rules(spark), WORDS)
    each = found.select("kind", F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), verdict(t).alias("verdict")) for t in TIERS))).alias("v"))
    return each.groupBy("v.tier", "kind", "v.verdict").agg(F.count("*").alias("n"))


def fx2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with the fixes of the highest tier: counts, digest and number of fixes."""
    return _fixed(spark, sf_dir, "lexical_contextual").select("doc_id", "applied", "skipped", "declined", F.size("fixes").alias("n_fixes"), F.sha2("text", 256).alias("digest"))


QUERIES = {"fx1_tier_verdicts": fx1, "fx2_tiered_fixes": fx2}
