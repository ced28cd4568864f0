"""Expected results written by hand, on texts that pass the view unchanged."""

import pytest

from inkstone import api, queries
from inkstone.functions import prose
from inkstone.sources.files import read_texts, write_fixed

TEXTS = {
    1: "這個軟件很好。用戶在https://a.b/軟件 @user1 下載軟件",
    2: "運行程序。法律程序。用戶端點和信息素",
    3: "# 軟件說明\n\n他們買蘋果和香蕉，鼠標壞了。",
    4: "工程序列很長。軟件，程序",
    5: "“甲‘乙’丙”\n\n‘丁’",
    6: "他來了。他走了。\n\n他笑了。他哭了。他睡了。",
    7: "﻿開頭﻿中間​結尾👍‍👍",
    8: "Visit our site, 你好, iPhone與github和my_github",
    9: "| 軟件 | 說明 |\n「軟件」一詞，軟件",
    10: "祖國的視頻“优化软件”和“数据”，视",
    11: "被" + "好" * 199,
    12: "甲的乙的丙的丁的，" + "好" * 191,
    13: "被" + "好" * 198,
    14: "https://a.b/被被被被 " + "好" * 199,
}


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("goldens"))
    spark.createDataFrame([(i, x, "zh", "s", len(x)) for i, x in TEXTS.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return lambda name: [tuple(r) for r in queries.QUERIES[name](spark, folder).collect()]


def only(rows, doc):
    return sorted(r[1:] for r in rows if r[0] == doc)


def test_places_and_masks(run):
    found = run("snk1_json_lines")
    assert [s for s, _ in only(found, 1)] == [2, 7, 34] and '"found":"軟件"' in only(found, 1)[0][1]
    assert [s for s, _ in only(found, 2)] == [0, 2, 7]  # longer forms cover the rest
    assert only(run("sc19_places"), 9) == [("軟件", "2,13,19")]


def test_fixes_are_spliced(run):
    import hashlib

    got = {r[0]: r[2] for r in run("fx2_fixed_text")}
    fixed = {1: "這個軟體很好。使用者在https://a.b/軟件 @user1 下載軟體", 2: TEXTS[2], 4: "工程序列很長。軟體，程序"}
    assert {d: hashlib.sha256(x.encode()).hexdigest() for d, x in fixed.items()} == {d: got[d] for d in fixed}
    assert only(run("fx4_offset_shift"), 1) == [(2, 2), (7, 7), (34, 35)]


def test_policies(run):
    glossary = run("pol6_glossary")
    # A covered banned term is one error at its finding, an uncovered one an error of its own.
    assert only(glossary, 3) == [("軟件", 2, 1, 2), ("香蕉", 3, 1, 14), ("鼠標", 3, 1, 17)]
    assert {r[0] for r in run("pol11_stance") if r[2]} == {"political_coloring"}
    assert only(run("pol12_heading_boost"), 3) == [(2, "軟件", 3)]
    assert only(run("pol13_table_cells"), 9) == [(0, 1, "軟件", 1)]
    assert only(run("ai39_mentions"), 9) == [("軟件", 1, 2)]
    assert only(run("pol10_baseline"), 10) == []  # the same kind, form and document as under the base layer


def test_ruleset_hash_sees_targets():
    """One target changes the hash; the order of rows doesn't."""
    import duckdb

    from inkstone.dialect import DUCK
    from inkstone.operators import stores
    from inkstone.plans.registered import Names

    rows = [(i, f"name {i}", f"Brand#{i % 3}", "ECONOMY", 10 + i % 30, 900.0) for i in range(40)]

    def hash_of(table):
        con = duckdb.connect()
        con.execute("CREATE TABLE part (p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INT, p_retailprice DOUBLE)")
        con.executemany("INSERT INTO part VALUES (?, ?, ?, ?, ?, ?)", [list(r) for r in table])
        return con.execute(stores.pol17(DUCK, Names())).fetchall()

    assert hash_of(rows) == hash_of(rows[::-1])
    assert hash_of(rows) != hash_of([*rows[:7], (*rows[7][:3], "PROMO", *rows[7][4:]), *rows[8:]])


def test_segments_quotes_and_gates(run):
    assert only(run("seg6_straddled_hits"), 4) == [(1, "程序", "工程")]
    assert only(run("ort7_quote_depth"), 5) == [
        (0, 0, "“", 0, "「"), (0, 2, "‘", 1, "『"), (0, 4, "’", 1, "』"), (0, 6, "”", 0, "」"), (1, 0, "‘", 0, "「"), (1, 2, "’", 0, "」"),
    ]
    assert only(run("tr4_pronoun_run"), 6) == [(1, 0, 3)]  # runs stop at paragraphs
    assert only(run("ai16_suspicious_characters"), 7) == [(3, 1), (6, 1)]
    gates = run("lex6_gates")
    assert ("程序", "passes", 1) in only(gates, 2) and ("程序", "clues", 1) in only(gates, 4)
    assert [r[1:] for r in only(run("seg7_clue_tokens"), 2) if r[1] == "運行"] == [("運行", 1)]
    assert only(run("ort4_latin_clause"), 8) == [(1, 1)]
    assert only(run("lex16_casing"), 8) == [("github", "GitHub", 1)]
    assert only(run("exc7_block_boundaries"), 3) == [(0, "# ")]
    import hashlib

    assert only(run("pre8_conversion_of_values"), 10) == [(2, hashlib.sha256("祖國的視頻“優化軟體”和“資料”，视".encode()).hexdigest())]


def test_ranges_edits_and_files(spark, tmp_path):
    text = "été x"
    normal, places = prose.normalised(text)
    assert normal == "été x" and prose.forward(places, 0, 2) == (0, 1) and prose.forward(places, 2, 3) == (1, 2) and prose.forward(places, 3, 5) == (2, 3)
    assert prose.forward([], 3, 5) == (3, 5)
    assert prose.edit_score("軟件和用戶", "軟體和使用者", "軟體和用戶") == (1, 3, 1) or prose.edit_score("軟件和用戶", "軟體和使用者", "軟體和用戶")[2] == 1
    rows = spark.createDataFrame([(1, "軟件", "軟體", "軟體"), (2, None, "", None)], "doc_id long, text string, expected string, got string")
    assert sorted((r.doc_id, r.f1) for r in api.edit_scores(rows).collect()) == [(1, 1.0), (2, None)]
    (tmp_path / "sub").mkdir()
    for name in ("a.md", "b.json", "c.bin", "sub/d.TXT", "sub/e.yml"):
        (tmp_path / name).write_text("軟件")
    got = {r.path.rsplit("/", 1)[1]: r.content_type for r in read_texts(spark, [str(tmp_path)], exclude=("e.*",)).collect()}
    assert got == {"a.md": "markdown", "d.TXT": "plain"}
    assert read_texts(spark, [str(tmp_path / "b.json")]).first().content_type == "json"
    docs = spark.createDataFrame([(1, "軟件")], "doc_id long, text string")
    for _ in range(2):
        write_fixed(api.fix(docs), str(tmp_path / "out"))
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["軟體"]


def test_translation_score_by_domain(run):
    """By hand: excess over the threshold by the threshold, held to 0.1 and 2, times the weight, over the weights' sum of 3.6."""
    scores = {(r[0], r[1]): r[2] for r in run("sc7_domain_thresholds")}
    assert {k[0] for k in scores} >= {11, 12, 14} and 13 not in {k[0] for k in scores}
    assert [scores[11, x] for x in ("general", "technical", "literary", "news")] == [0.185185, 0.0, 0.555556, 0.277778]
    assert [scores[12, x] for x in ("general", "literary")] == [0.019444, 0.157407]
    assert scores[14, "literary"] == 0
    general = {r[0]: tuple(r[1:]) for r in run("sc6_translation_score")}
    assert general[11] == (200, 1, 0, 0, 0, 0, 0.185185) and general[12] == (200, 0, 0, 0, 1, 4, 0.019444)
