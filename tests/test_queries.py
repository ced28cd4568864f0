"""Operators against the SQL of another engine, on a small table of their own."""

import duckdb
import pytest

from inkstone import api, queries
from inkstone.operators import stores
from inkstone.streaming.incremental import scan_new

NAMES = (
    "lex1_matches lex2_spelling lex9_clue_gate lex16_casing pre4_script pre6_lines pre7_conversion pre10_register seg1_sentences seg2_paragraphs ort1_halfwidth_marks ort13_repetition_latin "
    "grm1_a_not_a_with_ma tr4_pronoun_run rh2_ending_monotony ai6_phrase_density ai13_mixed_address ai22_mechanical_bullets sc1_machine_score sc3_punctuation_profile sc8_longest_de_chain "
    "sc14_top_findings pol6_glossary pol9_translation_memory pol20_evaluation fx2_fixed_text fx4_offset_shift snk3_compact_report"
).split() + sorted(stores.OPS)


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    words = "alpha the the beta of gamma and delta to in is that it was for on are with as at be by de la le et les des en un que pour par der die und zu von ist".split()
    rows = [(i, " ".join(words[(i * 7 + j) % len(words)] for j in range(40 + i % 30)) + " end", "en", f"src{i % 3}", 1) for i in range(60)]
    rows += [(60, "", "en", "src0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kinds, types = "click view error purchase signup".split(), "ECONOMY STANDARD PROMO LARGE".split()
    parts = [(i, ["small ring", "red widget", "blue bolt"][i % 3], f"Brand#{i % 5}", types[i % 4], 1 + i * 7 % 50, 900.0 + i) for i in range(120)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    events = [(i, f"2024-01-{1 + i % 28:02d} 00:00:{i % 60:02d}", i * 3 % 17, kinds[i * 7 % 5], f'{{"k": {i % 4}}}') for i in range(200)]
    events = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, props string").selectExpr("event_id", "timestamp(ts) AS ts", "user_id", "event_type", "props")
    events.write.parquet(f"{folder}/events.parquet")
    return folder


def plain(rows, names):
    cell = lambda v: round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted([[str(cell(r[n])) for n in sorted(names)] for r in rows])


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, tables)
    con = duckdb.connect()
    for t in ("documents", "labels", "part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    expected = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert sorted(got.columns) == sorted(names)
    from decimal import Decimal

    expected = [{k: float(v) if isinstance(v, Decimal) else v for k, v in r.items()} for r in expected]
    found = [{k: float(v) if isinstance(v, Decimal) else v for k, v in r.asDict().items()} for r in got.collect()]
    assert plain(found, names) == plain(expected, names)


def test_scan_places_and_nulls(spark):
    docs = spark.createDataFrame([(1, "😀好\n這個軟件很好"), (2, None), (3, "")], "doc_id long, text string")
    rows = api.scan(docs).collect()
    assert [(r.doc_id, r.start, r.byte_start, r.line, r.col, r.found) for r in rows] == [(1, 5, 14, 2, 3, "軟件")]
    fixed = {r.doc_id: r.text for r in api.fix(docs).collect()}
    assert fixed == {1: "😀好\n這個軟體很好", 2: None, 3: ""}
    assert api.convert(spark.createDataFrame([(1, "优化软件")], "doc_id long, text string")).first().text == "優化軟體"


def test_stream_of_documents_scans_each_content_once(spark, tmp_path):
    rows = [(1, "軟件", "2024-01-01 00:00:00"), (2, "軟件", "2024-01-01 00:00:01"), (3, "硬件", "2024-01-01 00:00:02")]
    spark.createDataFrame(rows, "doc_id long, text string, seen_at string").selectExpr("doc_id", "text", "timestamp(seen_at) AS seen_at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string, seen_at timestamp").parquet(str(tmp_path / "in"))
    q = scan_new(stream).writeStream.format("memory").queryName("found_terms").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.found for r in spark.sql("SELECT found FROM found_terms").collect()) == ["硬件", "軟件"]
