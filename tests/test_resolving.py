"""Each way to resolve an ambiguous finding by hand, judgments and questions."""

from pyspark.sql import functions as F

from inkstone.operators import resolving
from inkstone.operators.resolving import JUDGMENTS, TABLES, judged, judgment_key, questions, remembered, scored, terms_of
from inkstone.operators.rule_scan import rules_of, scan_rules

RULES = [
    {"rule_id": 1, "source": "進程", "targets": ["行程", "程序"], "kind": "cross_strait", "severity": 2, "english": "process"},
    {"rule_id": 2, "source": "文件", "targets": ["檔案", "文書"], "kind": "confusable", "severity": 2, "clues": []},
    {"rule_id": 3, "source": "軟件", "targets": ["軟體"], "kind": "cross_strait", "severity": 2},
    {"rule_id": 4, "source": "錯字", "targets": ["x", "y"], "kind": "typo", "severity": 3},
    {"rule_id": 5, "source": "程序", "targets": ["程式", "程序"], "kind": "cross_strait", "severity": 2, "clues": ["運行", "編譯"]},
]
PAIRS = [("進程", "排程", "行程", 1), ("進程", "安裝", "程序", 2), ("進程", "無此", "沒有", 0)]
VETOES = [("進程", "歷史")]
PRIORS = [("文件", "文書", 0.4), ("程序", "程序", 0.1)]


def tables(spark):
    return tuple(spark.createDataFrame(x, TABLES[k]) for k, x in (("collocations", PAIRS), ("vetoes", VETOES), ("priors", PRIORS)))


def resolve(spark, cases):
    """(resolution, score, first suggestion, severity) of the one finding of each (text, anchor)."""
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    anchors = spark.createDataFrame([(i, a) for i, (_, a) in enumerate(cases)], "doc_id long, anchor boolean")
    t = tables(spark)
    found = scan_rules(docs, rules_of(spark, RULES), terms=terms_of(*t[:2]), windows=True).join(anchors, "doc_id")
    rows = {r.doc_id: r for r in scored(found, *t).collect()}
    return [(rows[i].resolution, rows[i].score, rows[i].suggestions[0], rows[i].severity) for i in range(len(cases))]


def test_tier_two_by_hand(spark):
    cases = {
        ("軟件", None): (None, None, "軟體", 2),
        ("軟件", True): ("anchor", 1.0, "軟體", 2),
        ("錯字", None): (None, None, "x", 3),
        ("排程的進程", None): ("collocation", 1.0, "行程", 2),
        ("安裝的進程", None): ("collocation", 1.0, "程序", 2),
        ("安裝排程的進程", None): ("collocation", 1.0, "行程", 2),
        ("無此進程", None): ("suppressed", 0.0, "行程", 1),
        ("歷史的進程", None): ("suppressed", 0.0, "行程", 1),
        ("歷史。" + "好" * 40 + "進程", None): ("suppressed", 0.0, "行程", 1),
        ("排程\n\n進程", None): ("suppressed", 0.0, "行程", 1),
        ("排程。\n進程", None): ("collocation", 1.0, "行程", 2),
        ("文件", None): ("open", 0.4, "檔案", 2),
        ("文件", True): ("prior", 0.6, "文書", 2),
        ("文件", False): ("suppressed", 0.2, "檔案", 1),
        ("運行程序", None): ("clues", 0.6, "程式", 2),
        ("運行編譯程序", None): ("clues", 0.8, "程式", 2),
        ("運行程序", False): ("open", 0.4, "程式", 2),
    }
    got = resolve(spark, list(cases))
    assert dict(zip(cases, got)) == cases


def test_judgments(spark):
    """A choice goes first, a refusal suppresses; what ran out or has another key says nothing."""
    columns = "doc_id long, found string, english string, suggestions array<string>, severity int, eligible boolean, resolution string, score double, context string"
    rows = spark.createDataFrame([(i, "文件", None, ["檔案", "文書"], 2, True, r, 0.4, c) for i, (r, c) in enumerate([("open", "甲 乙"), ("open", "甲乙"), ("open", "丙"), ("open", "丁"), ("clues", "甲乙"), ("open", "戊")])], columns)
    rows = rows.withColumn("key", judgment_key(F.col("context"), "r", "p", "plain"))
    keys = {r.context: r.key for r in rows.collect()}
    assert keys["甲 乙"] == keys["甲乙"] != keys["丙"]
    other = rows.withColumn("k2", judgment_key(F.col("context"), "r2", "p", "plain")).first()
    assert other.k2 != other.key
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    said = [(keys["甲乙"], "檔案", 0.7, at(1), at(30)), (keys["甲乙"], "文書", 0.9, at(2), at(30)), (keys["丙"], None, 0.8, at(1), at(30)), (keys["丁"], "文書", 0.9, at(1), at(3))]
    table = spark.createDataFrame(said, "key string, chosen string, confidence double, made string, expires string").selectExpr("key", "chosen", "confidence", "timestamp(made) AS made", "timestamp(expires) AS expires")
    now = F.lit(at(5)).cast("timestamp")
    done = judged(rows, table, now)
    got = {r.doc_id: (r.resolution, r.suggestions[0], r.severity, r.score) for r in done.collect()}
    assert got == {0: ("judged", "文書", 2, 0.9), 1: ("judged", "文書", 2, 0.9), 2: ("refused", "檔案", 1, 0.8), 3: ("open", "檔案", 2, 0.4), 4: ("clues", "檔案", 2, 0.4), 5: ("open", "檔案", 2, 0.4)}
    twice = done.unionByName(done.where("doc_id = 5"))
    assert [(r.key == keys["戊"], r.n) for r in questions(twice, 1).collect()] == [(True, 2)]
    assert questions(twice, 10).count() == 2
    kept = remembered(table, table.limit(0), now).collect()
    assert sorted((r.key, r.chosen) for r in kept) == sorted([(keys["甲乙"], "文書"), (keys["丙"], None)]) and len(JUDGMENTS.split(",")) == 5
    assert remembered(table, table, now, most=1).count() == 1


def test_surroundings_are_the_middle_eighty(spark):
    row = lambda c: spark.createDataFrame([(c, "文件", None, ["a"])], "context string, found string, english string, suggestions array<string>").select(judgment_key(F.col("context"), "r", "p", "plain").alias("k")).first().k
    long = "x" * 10 + "".join(chr(0x4E00 + i) for i in range(80)) + "y" * 10
    assert row(long) == row("z" * 10 + long[10:90] + "w" * 10) != row(long[:50] + "q" + long[51:])
    assert resolving.QUESTION == 1
