"""Rewritten tables, repeated ids, and texts that are long in one way or another."""

import duckdb
import pytest

from inkstone.dialect import DUCK, SPARK
from inkstone.operators import detectors, documents
from inkstone.operators.detectors import rh2
from inkstone.operators.lexical import matches
from inkstone.operators.shapes import SHAPES, findings
from inkstone.plans.registered import Names, _doubles, _long_sums
from inkstone.queries import QUERIES

#: Texts of some 100,000 characters that make an engine go back, go deep, or read again.
LONG = {
    "de chain": "的人" * 50_000,
    "head chain": "理解的" * 33_000,
    "letters": "a" * 100_000,
    "letters and digits": "aB3" * 33_000,
    "points": "好." * 50_000,
    "brackets": "(" * 100_000,
    "quotes": "“好" * 50_000,
    "blanks": " " * 100_000,
    "commas": "好，" * 50_000,
}


def test_long_texts_end(spark):
    rows = spark.createDataFrame(list(LONG.items()), "doc_id string, zh string")
    rows.createOrReplaceTempView("long_docs")
    for name, shape in SHAPES.items():
        spark.sql(_doubles(findings(shape, SPARK, "long_docs"))).write.format("noop").mode("overwrite").save()
        assert spark.range(1).count() == 1, name


def test_chains_of_any_length(spark):
    spark.createDataFrame([(1, "甲的" * 5_000), (2, "好" + "，理解" + "的理解" * 20_000)], "doc_id long, zh string").createOrReplaceTempView("chain_docs")
    found = {n: spark.sql(_doubles(findings(SHAPES[n], SPARK, "chain_docs"))).collect() for n in ("tr7_de_chain", "tr16_head_chain")}
    assert [(r.doc_id, r.start, len(r.found)) for r in found["tr16_head_chain"]] == [(2, 2, 60_002)]
    assert sorted((r.doc_id, r.start, len(r.found)) for r in found["tr7_de_chain"]) == [(1, 0, 10_000), (2, 2, 60_002)]


def test_a_rewritten_table_is_read_anew(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    for text, n in (("x the y", 1), ("x the y the z", 2), ("none", 0)):
        spark.createDataFrame([(1, text)], "doc_id long, text string").write.mode("overwrite").parquet(path)
        assert sum(r.n for r in QUERIES["lex1_matches"](spark, str(tmp_path)).where("found = '軟件'").collect()) == n


def test_places_of_rows_with_equal_ids(spark):
    rows = [(1, "軟件"), (1, "甲乙軟件"), (None, "軟件"), (None, "甲軟件")]
    spark.createDataFrame(rows, "doc_id long, zh string").createOrReplaceTempView("same_docs")
    found = spark.sql(f"SELECT * FROM {matches(SPARK, Names(), source='same_docs')}").collect()
    assert sorted(((str(r.doc_id), r.start) for r in found)) == [("1", 0), ("1", 2), ("None", 0), ("None", 1)]


class Table(Names):
    zh = documents = "rule_docs"

    def __init__(self):
        pass


def both(spark, sql, rows, columns):
    """Rows of an operator over (doc_id, zh, text) in both engines, which must agree."""
    spark.createDataFrame([(i, x, x) for i, x in rows], "doc_id long, zh string, text string").createOrReplaceTempView("rule_docs")
    got = sorted(tuple(r) for r in spark.sql(_doubles(sql(SPARK, Table()))).select(*columns).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE rule_docs (doc_id BIGINT, zh VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO rule_docs VALUES (?, ?, ?)", [[i, x, x] for i, x in rows])
    assert sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({_long_sums(_doubles(sql(DUCK, Table())))})").fetchall()) == got
    return got


def test_endings_of_one_particle(spark):
    rows = [(1, "他好的。他壞了。他走呢。"), (2, "他去了。他來了！他走了」。他坐下。"), (3, "好的。好的。\n\n好的。"), (4, "好的。對的。是的。走了。來了。去了。")]
    assert both(spark, rh2, rows, ("doc_id", "particle", "n")) == [(2, "了", 3), (4, "了", 3), (4, "的", 3)]


def test_repeated_latin_words(spark):
    rows = [(1, "foo\n\n\nfoo"), (2, "foo \n foo bar"), (3, "the the the"), (4, "the the the the"), (5, "foo, foo"), (6, "cache cacheé"), (7, "ab ab"), (8, "Foo\r\nfoo"), (9, "foo\tFOO")]
    assert both(spark, documents.ort13, rows, ("doc_id", "n")) == [(2, 1), (3, 1), (4, 2), (8, 1), (9, 1)]


@pytest.mark.parametrize("text, depths", [("“他說‘好’”", [0, 1, 1, 0]), ("it’s “好”", [0, 0]), ("”好“壞”", [0, 0, 0])])
def test_quote_depth(spark, text, depths):
    from inkstone.operators.contexts import ort7

    assert [r[1] for r in both(spark, ort7, [(1, text)], ("start", "depth"))] == depths


def test_signature_by_hand(spark):
    """Even punctuation gives 0.1; each family of prose 0.1, of layout 0.05; defects and short texts nothing."""
    from inkstone.operators.signature import sc1_signature

    even = "甲乙丙丁戊。" * 100
    rows = [
        (1, even), (2, even + "\n廢話不多說，開始"), (3, even[:300]), (4, even + "\n- **甲**：乙\n- **丙**：丁\n- **戊**：己\n"), (5, even + "你好您好"),
        (6, even + "\n廢話不多說，開始。\n說實話？對"), (7, even + "​"), (8, None), (9, "甲" * 600),
    ]
    # In text 6 one gap of ten among 99 of six: a variation of 0.0659, and (0.5 - 0.0659) / 0.5 * 0.1 for it.
    got = {i: (prose, layout, score) for i, prose, layout, score in both(spark, sc1_signature, rows, ("doc_id", "prose", "layout", "score"))}
    assert got == {1: (0, 0, 0.1), 2: (1, 0, 0.2), 4: (0, 1, 0.15), 5: (0, 0, 0.1), 6: (2, 0, 0.28682), 7: (0, 0, round(0.1 + 0.2 / 3, 5)), 9: (0, 0, 0.0)}


@pytest.mark.parametrize("name", ["seg3_paragraph_sentences", "sc5_sentence_variability", "rh2_ending_monotony", "rh3_staccato"])
def test_abbreviations_behind_ideographs(spark, name):
    """An abbreviation begins a word behind an ideograph or an accented letter too."""
    texts = ["軟件Mr. Wang去了。", "é No. X了。Dr. 好了。好Dr. 好了。", "了。軟件vs. A了。人了。" * 4, "甲乙了。丙丁了。好Mr. 好了了。戊己了。", "aNo. 好。xMr. Wang。_Dr. 好。"]
    rows = [(i, x) for i, x in enumerate(texts * 2)] + [(99, "甲乙丙。" * 9 + "丁戊Dr. 己庚。" + "甲乙。丙丁。好St. 好。")]
    columns = {"seg3_paragraph_sentences": "doc_id para n", "sc5_sentence_variability": "doc_id n deviation", "rh2_ending_monotony": "doc_id para particle first_ord n", "rh3_staccato": "doc_id para first_ord n"}
    assert both(spark, (documents.OPS | detectors.OPS)[name], rows, columns[name].split())
