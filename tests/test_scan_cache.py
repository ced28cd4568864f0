"""The stored cache: what is scanned, what runs out, and what fits."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from inkstone.operators import scan_cache
from inkstone.operators.rule_scan import rules_of, scan_rules
from inkstone.operators.scan_cache import ENTRIES, scan_cached, within_budget

RULES = [{"rule_id": 1, "source": "軟件", "targets": ["軟體"], "kind": "k", "severity": 1}]
DAY = datetime(2024, 5, 1)


def entries(spark, folder):
    return spark.read.schema(ENTRIES).parquet(scan_cache._versions(spark, folder)[1][-1][1])


def rows(df):
    return sorted((str(r.doc_id), r.start, r.found, r.suggestions) for r in df.collect())


def test_only_new_contents_are_scanned(spark, tmp_path):
    folder, rules = str(tmp_path / "cache"), rules_of(spark, RULES)
    make = lambda xs: spark.createDataFrame(xs, "doc_id long, text string")
    first = make([(1, "軟件"), (2, "好軟件"), (3, "軟件"), (None, "無"), (5, None)])
    assert rows(scan_cached(first, rules, folder, now=DAY)) == rows(scan_rules(first, rules))
    assert entries(spark, folder).count() == 3
    second = make([(1, "軟件"), (2, "好軟件軟件"), (7, "好軟件")])
    assert rows(scan_cached(second, rules, folder, now=DAY + timedelta(days=1))) == rows(scan_rules(second, rules))
    assert [r.held for r in entries(spark, folder).where(F.col("made") > F.lit(DAY)).collect()] == [len("好軟件軟件".encode())]
    other = rules_of(spark, [{**RULES[0], "targets": ["x"]}])
    assert rows(scan_cached(second, other, folder, now=DAY + timedelta(days=2))) == rows(scan_rules(second, other))
    assert entries(spark, folder).where(F.col("made") > F.lit(DAY + timedelta(days=1))).count() == 3
    # The first rules' entries are still there, until they are too old.
    scan_cached(second, rules, folder, now=DAY + timedelta(days=3))
    assert entries(spark, folder).where(F.col("made") > F.lit(DAY + timedelta(days=2))).count() == 0
    scan_cached(second, rules, folder, now=DAY + timedelta(days=30, hours=12), time_to_live=timedelta(days=30))
    assert entries(spark, folder).where(F.col("made") > F.lit(DAY + timedelta(days=3))).count() == 2
    assert len(scan_cache._versions(spark, folder)[1]) == 2
    assert scan_cached(make([]), rules, str(tmp_path / "none"), now=DAY).count() == 0


def test_budget_against_a_plain_walk(spark):
    r = random.Random(9)
    for step in (1, 60, 4000):
        made = [(f"d{i:03d}", DAY + timedelta(seconds=r.randrange(60) * step), r.randint(1, 50)) for i in range(120)]
        table = spark.createDataFrame([(d, "p", [], h, m) for d, m, h in made], ENTRIES)
        for budget in (0, 1, 300, 1500, 10_000):
            want, total = set(), 0
            # Newest first; within a minute that the budget cuts, entries go by time and digest.
            for d, m, h in sorted(made, key=lambda x: (-x[1].timestamp(), x[0])):
                total += h
                if total <= budget:
                    want.add(d)
            assert {x.digest for x in within_budget(table, budget).collect()} == want
