"""Verdicts by hand, fixes against a plain loop, and what is carried over a second scan."""

import random

import pytest
from pyspark.sql import functions as F

from inkstone.operators import fixing
from inkstone.operators.fixing import FINDINGS, apply_fixes, carried, findings_of, fix, keyed, moved, unsettled, verdict, written
from inkstone.operators.rule_scan import rules_of

NAMES = [c.split()[0] for c in FINDINGS.split(", ")]
PLAIN = dict(doc_id=1, start=0, finish=2, found="軟件", kind="cross_strait", severity=2, english="software", suggestions=["軟體"], clues=0, gated=False, confidence=None, anchor=None, judged=None, advisory=False)

#: What differs from PLAIN, and the verdict of each tier above none.
LADDER = [
    ({}, "skip apply apply"),
    ({"kind": "punctuation"}, "apply apply apply"),
    ({"kind": "case"}, "apply apply apply"),
    ({"suggestions": ["a", "b"]}, "skip decline decline"),
    ({"kind": "variant", "suggestions": ["a", "b"]}, "decline decline decline"),
    ({"suggestions": []}, "skip skip skip"),
    ({"gated": True}, "skip skip decline"),
    ({"gated": True, "clues": 1}, "skip skip apply"),
    ({"gated": True, "clues": 1, "kind": "confusable"}, "skip skip decline"),
    ({"gated": True, "clues": 2, "kind": "confusable"}, "skip skip apply"),
    ({"confidence": "low"}, "skip decline apply"),
    ({"anchor": False}, "skip decline decline"),
    ({"anchor": True}, "skip apply apply"),
    ({"anchor": False, "gated": True, "clues": 1}, "skip skip apply"),
    ({"judged": "suppressed"}, "skip decline decline"),
    ({"judged": "suppressed", "kind": "spacing"}, "apply apply apply"),
    ({"advisory": True}, "skip skip skip"),
    ({"kind": "ai_style", "found": "​", "suggestions": [""]}, "apply apply apply"),
    ({"kind": "ai_style", "found": "‍", "suggestions": [""]}, "decline decline decline"),
    ({"kind": "ai_style", "found": "﻿", "suggestions": [""]}, "decline decline decline"),
    ({"kind": "ai_style", "found": "﻿", "suggestions": [""], "start": 5}, "apply apply apply"),
    ({"kind": "ai_style", "found": "說實話", "suggestions": [""]}, "skip apply apply"),
]


def table(spark, rows):
    return spark.createDataFrame([tuple({**PLAIN, **r}[n] for n in NAMES) for r in rows], FINDINGS)


def test_ladder(spark):
    rows = table(spark, [{**r, "doc_id": i} for i, (r, _) in enumerate(LADDER)]).select("doc_id", *(verdict(t).alias(t) for t in fixing.TIERS)).collect()
    got = {r.doc_id: " ".join([r.orthographic, r.lexical_safe, r.lexical_contextual]) for r in rows}
    assert got == {i: v for i, (_, v) in enumerate(LADDER)} and {r.none for r in rows} == {"skip"}


def test_json_admits_no_quotes(spark):
    rows = table(spark, [{"doc_id": i, "suggestions": [s]} for i, s in enumerate(["好", 'a"b', "a\\b", "a\nb"])])
    assert [r.doc_id for r in rows.where(fixing.admitted("json")).collect()] == [0]
    assert rows.where(fixing.admitted("plain")).count() == 4


def plain_loop(text, findings):
    """One finding after another, from the right, over those that a walk from the left takes."""
    at, barrier, taken, declined = 0, 0, [], 0
    for f in findings:
        if f["start"] < at or f["kind"] == "grammar" and f["start"] < barrier:
            continue
        if f["verdict"] == "decline":
            declined, barrier = declined + 1, max(barrier, f["finish"])
        if f["verdict"] == "apply":
            taken.append(f)
            at = f["finish"]
    for f in reversed(taken):
        text = text[: f["start"]] + f["suggestions"][0] + text[f["finish"] :]
    return text, len(taken), len(findings) - len(taken), declined


def test_splicing_against_a_plain_loop():
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choice("甲乙丙丁") for _ in range(r.randint(0, 40)))
        found = sorted(
            ({"start": a, "finish": min(len(text), a + r.randint(0, 5)), "kind": r.choice(["grammar", "term"]), "suggestions": ["x" * r.randint(0, 4)], "verdict": r.choice(["apply", "skip", "decline"])} for a in (r.randint(0, len(text)) for _ in range(r.randint(0, 8)))),
            key=lambda f: (f["start"], -f["finish"]),
        )
        *got, fixes = fixing.spliced(text, found)
        assert tuple(got) == plain_loop(text, found)
        assert all(text[f["start"] : f["start"] + f["old"]] != "" or f["old"] == 0 for f in fixes)


RULES = [
    {"rule_id": 1, "source": "軟件", "targets": ["軟體"], "kind": "cross_strait", "severity": 2, "english": "software"},
    {"rule_id": 2, "source": "文件", "targets": ["檔案"], "kind": "confusable", "severity": 1, "clues": ["打印", "軟件"]},
    {"rule_id": 3, "source": "進程", "targets": ["行程", "程序"], "kind": "cross_strait", "severity": 2},
    {"rule_id": 4, "source": "大概", "targets": [""], "kind": "ai_filler", "severity": 1},
]


@pytest.mark.parametrize(
    "tier, text, expected, counts",
    [
        ("none", "軟件,好", "軟件,好", (0, 2, 0)),
        ("orthographic", "軟件,好", "軟件，好", (1, 1, 0)),
        ("lexical_safe", "軟件,進程", "軟體，進程", (2, 1, 1)),
        ("lexical_safe", "大概，好", "好", (1, 0, 0)),
        ("lexical_safe", "打印軟件文件", "打印軟體文件", (1, 1, 0)),
        ("lexical_contextual", "打印軟件文件", "打印軟體檔案", (2, 0, 0)),
        ("lexical_contextual", "打印文件", "打印文件", (0, 1, 1)),
        ("lexical_safe", "看https://a.b/軟件", "看https://a.b/軟件", (0, 0, 0)),
        ("lexical_safe", "", "", (0, 0, 0)),
        ("lexical_safe", None, None, (0, 0, 0)),
    ],
)
def test_tiers(spark, tier, text, expected, counts):
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    rows = fix(docs, rules_of(spark, RULES), tier).collect()
    assert [(r.text, (r.applied, r.skipped, r.declined)) for r in rows] == [(expected, counts)] * 2


def test_content_types(spark):
    docs = spark.createDataFrame([(1, '{"軟件": "軟件"}')], "doc_id long, text string")
    assert fix(docs, rules_of(spark, RULES), content_type="json").first().text == '{"軟件": "軟體"}'
    docs = spark.createDataFrame([(1, "`軟件` 軟件")], "doc_id long, text string")
    assert fix(docs, rules_of(spark, RULES), content_type="markdown").first().text == "`軟件` 軟體"


def test_places_after_fixes(spark):
    fixes = [(2, 2, "abc"), (6, 1, ""), (9, 0, "xy")]
    row = spark.createDataFrame([(fixes,)], f"fixes {fixing.FIXES}").select(*(moved(F.lit(p), F.col("fixes")).alias(str(p)) for p in (0, 2, 4, 6, 7, 9, 10)), written(F.col("fixes")).alias("w")).first()
    assert [row[str(p)] for p in (0, 2, 4, 6, 7, 9, 10)] == [0, 2, 5, 7, 7, 9, 12]
    assert [(w.a, w.b) for w in row.w] == [(2, 5), (7, 7), (9, 11)]


def test_second_scan(spark):
    """What touches a fix is settled; judgments stay with what they were about."""
    text = "軟件好進程,進程"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rules = rules_of(spark, [*RULES, {"rule_id": 9, "source": "體好", "targets": ["x"], "kind": "typo", "severity": 3}, {"rule_id": 10, "source": "軟件好", "targets": [], "kind": "k", "severity": 1, "places": ["before:沒有"]}])
    first = findings_of(docs, rules).withColumn("severity", F.when((F.col("found") == "進程") & (F.col("start") > 4), 7).otherwise(F.col("severity")))
    first = first.withColumn("suggestions", F.when(F.col("severity") == 7, F.array(F.lit("程序"))).otherwise(F.col("suggestions")))
    named = first.withColumn("doc_id", F.xxhash64(F.lit(text)))
    fixed = apply_fixes(docs, named.where("severity <> 7"), "lexical_safe")
    assert fixed.first().text == "軟體好進程，進程" or fixed.first().text == "軟件好進程，進程"
    later = findings_of(fixed.select("doc_id", "text"), rules)
    left = unsettled(later, fixed)
    assert "體好" not in {r.found for r in left.collect()}
    known = {(r.found, r.start): (r.severity, r.suggestions) for r in carried(left, first, fixed).collect()}
    places = sorted(s for f, s in known if f == "進程")
    assert known["進程", places[0]] == (2, ["行程", "程序"]) and known["進程", places[1]] == (7, ["程序"])


def test_a_shared_hash_writes_nothing_else(spark):
    docs = spark.createDataFrame([(1, "甲乙")], "doc_id long, text string")
    rows = table(spark, [{}]).withColumn("doc_id", F.xxhash64(F.lit("甲乙")))
    assert apply_fixes(docs, rows, "lexical_safe").first().text == "甲乙"
    assert keyed(docs).count() == 1


@pytest.mark.parametrize("query", [fixing.fx1, fixing.fx2])
def test_detectors_share_a_reading(spark, tmp_path, query):
    """Verdicts and fixes read the texts once for all detectors, and no finding is placed by a window."""
    spark.createDataFrame([(1, "a the b of c"), (2, "a the b of c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = query(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") <= 4
