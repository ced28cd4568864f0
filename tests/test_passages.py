"""Detectors over sentences, paragraphs and lines: findings by hand, in both engines, and behind a mask."""

import random
import time

import duckdb
import pytest

from inkstone.dialect import DUCK, SPARK
from inkstone.operators import structure
from inkstone.operators.passages import DETECTORS, masked, one_of_density
from inkstone.plans.registered import _doubles, _long_sums

LONG = "這是一段用來補足長度的文字，" * 36  # 504 characters
ENDS = "\n\n".join(["甲段說完，這是合作的基礎。", "乙段證明了一切。", "丙段平常。", "丁段平常。"])
FIVE = ENDS + "\n\n戊段揭示了方向。"
DASHED = "甲—乙—丙—丁。"

#: (text, (start, found, n, family) of each finding)
CASES = {
    "ai6_density_places": [
        ("好。不容忽視。" + LONG, [(2, "不容忽視", 1, "")]), ("不容忽視。", []), ("更重要的是。" + LONG + "更重要的是。", [(0, "更重要的是", 2, "")]),
        ("值得注意的是" + LONG * 7, []),
    ],
    "ai8_contrast_places": [
        ("他雖然慢，但穩。不僅快，還好。即使晚，卻對。" + LONG, [(1, "", 3, "binary_contrast")]), ("雖然慢，但穩。不僅快，還好。即使晚，卻對。", []),
        ("雖然慢。但穩。不僅快，還好。即使晚，卻對。" + LONG, []), ("不僅雖然慢，還但穩。即使晚，卻對。" + LONG, [(2, "", 3, "binary_contrast")]),
        ("雖然慢，即使晚。雖然慢，但穩。不僅快，還好。" + LONG, []),
    ],
    "ai9_ending_places": [(FIVE, [(0, "", 3, "paragraph_endings")]), (ENDS, []), ("平常。\n\n" + FIVE.replace("的基礎", "的好" + "長" * 30), []), ("\n\n" + FIVE, [(2, "", 3, "paragraph_endings")])],
    "ai10_dash_places": [("頭。\n\n" + "\n\n".join([DASHED] * 3), [(4, "", 3, "dash_overuse")]), ("\n\n".join([DASHED] * 2), []), ("\n".join([DASHED] * 3), [])],
    "ai11_heading_places": [("# 總結與展望\n文\n  ## 問題與挑戰一\n", [(0, "", 2, "formulaic_headings")]), ("# 總結與展望\n文", []), ("總結與展望\n# 問題與挑戰", [])],
    "ai12_list_places": [
        ("甲\n\n- 一\n\n乙\n\n* 二\n\n3. 三", [(3, "", 3, "list_density")]), ("甲\n\n- 一\n\n乙\n\n丙\n\n丁\n\n戊\n\n* 二\n\n3. 三", []), ("甲\n\n- 一\n\n乙\n\n* \n\n3.三", []),
    ],
    "ai14_please_places": [
        ("說明：\n- 請打開\n- 請關閉\n  細節\n2. 請離開\n", [(6, "請", 3, "stacked_please")]), ("- 請打開\n\n- 請關閉\n- 請離開", []), ("- 請打開\n- 關閉\n- 請離開\n- 請坐", []), ("請打開\n請關閉\n請坐", []),
    ],
    "ai19_closer_places": [
        ("開頭未來可期。中段。未來可期，值得期待。\n\n# 尾\n結束，任重道遠。", [(10, "未來可期", 1, "section_closers"), (15, "值得期待", 1, "section_closers"), (29, "任重道遠", 1, "section_closers")]),
        ("未來可期。還有。", []), ("# 未來可期\n好。", []), ("文\n# 題", []),
    ],
    "ai22_bullet_places": [
        ("列：\n- **一**：x\n- **二**：y\n  * **三**：z\n尾", [(3, "-", 3, "mechanical_bullets")]), ("- **重要特點**：x\n- **主要優勢**: y\n1. **其他方面**：z", [(0, "-", 3, "four_char_labels")]),
        ("- **一**：x\n- 二\n- **三**：z", []), ("- **一**：x\n- **二**：y\n\n- **三**：z", []),
    ],
    "ai23_bold_places": [
        ("好。他**愛**和**恨**。", [(2, "他*", 2, "bold_in_sentence")]), ("**愛**。", []), ("**愛**和**恨", []),
        ("這裡**甲**。那裡**乙**。還有**丙**。" + "湊足三十個字的段落需要更多文字。", [(0, "這裡", 3, "bold_in_paragraph")]),
    ],
    "ai24_em_dash_places": [("甲——乙——丙", [(1, "——", 2, "em_dash_overuse")]), ("甲——乙\n\n丙——丁", []), ("甲——乙", [])],
    "ai28_metaphor_places": [("有一條線，這條線和這條路延伸", [(1, "一條線", 2, "line_metaphor")]), ("脈絡：這條路線延伸", []), ("脈絡：這條路線延伸，這條路線", [(0, "脈絡", 2, "line_metaphor")]), ("有一條線，這條線和這條路", [])],
    "ai29_slogan_places": [
        ("頭。不是結束，而是開始。\n\n又說：不同。不是結束，而是開始。", [(2, "不是結束，而是開", 2, "repeated_slogan")]), ("不是結束，而是開始。不是結束，而是開始。", []),
        ("左邊有人；右邊有狗。\n\n左邊有人；右邊有狗。", [(0, "左邊有人；右邊有", 2, "repeated_slogan")]), ("左邊有人。\n\n左邊有人。", []), ("越走越遠就是了。\n\n越走越遠就是了。", []), ("他越走就越遠一些。\n\n他越走就越遠一些。", [(0, "他越走就越遠一些", 2, "repeated_slogan")]),
    ],
    "ai30_rhetorical_places": [
        ("好。那麼，你以為這樣好嗎？錯了。為什麼難？因為貴。", [(2, "那麼，你以為這樣好嗎？", 2, "rhetorical_questions")]), ("你以為這樣好嗎？錯了。", []), ("為什麼難？因為貴。為什麼難？因為貴。", []),
        ("Q：你以為這樣好嗎？錯了。為什麼難？因為貴。", []), ("FAQ。你以為這樣好嗎？錯了。為什麼難？因為貴。", []), ("你以為這樣好嗎？錯了。\n\n為什麼難？因為貴。", []),
    ],
    "ai32_reveal_places": [
        ("到底為什麼？因為愛。", [(0, "到底為什麼？", 1, "question_reveal")]), ("為什麼？因為愛。", []), ("好。為什麼？因為不是錢，而是人。", [(2, "為什麼？", 1, "question_reveal")]), ("他說「好。到底為什麼？因為愛。」", []),
        ("到底為什麼？\n\n因為愛。", []),
    ],
    "ai33_golden_places": [
        ("不是甲，而是乙。看，不是丙，而是丁。不是戊,而是己，好。", [(0, "不是甲，而是乙", 3, "golden_contrast")]), ("不是甲，而是乙。不是丙，而是丁。", []), ("是不是甲，而是乙。不是丙，而是丁。不是戊，而是己。", []),
        ("不是甲，而是乙。\n\n不是丙，而是丁。不是戊，而是己。", []),
    ],
    "ai34_verdict_places": [("說，你不是累，你只是忙，真的。你值得更好。", [(2, "你不是累，你只是忙，真的", 2, "psych_verdict")]), ("你值得更好。", []), ("他說「唉。你不是累，你只是忙。」你值得更好。", [])],
    "ai37_conclusion_places": [
        ("很多人去了。由此可見，好。", [(6, "由此可見", 1, "stock_conclusion")]), ("由此可見，好。", []), ("去了。由此可見，好。尾。", []), ("去了。由此可見，" + "好" * 20 + "。", []), ("受試者的樣本顯著。由此可見，好。", []),
        (FIVE + "\n\n去了。由此可見，好。", []),
    ],
    "ai38_depth_places": [("歸根結底，難。但，說到底，沒人懂。", [(0, "歸根結底", 2, "fake_depth")]), ("歸根結底，難。歸根結底，難。", []), ("歸根結底，難。\n\n說到底，難。", []), ("他歸根結底。說到底，難。", [])],
    "tr1_passive_places": [("頭。\n\n這件事被發現、被記住、被忘記，後來又慢慢平靜下去了。", [(4, "這件", 3, "")]), ("被發現被記住被忘記。", []), ("這件事被發現、被記住、被定義為問題，後來又慢慢平靜下去了。", [])],
    "tr14_one_of_places": [("他是畫家之一，也是詩人之一。" + "好" * 90, [(4, "之一", 2, "")]), ("他是畫家之一，也是詩人之一。", []), ("他是畫家之一，也是詩人之一。" + "好" * 250, [])],
}


def both(spark, detector, texts, name="passage_docs"):
    spark.createDataFrame(list(texts), "doc_id long, zh string").createOrReplaceTempView(name)
    columns = ("doc_id", "start", "found", "n", "family")
    rows = spark.sql(_doubles(detector(SPARK, masked(SPARK, name)))).select(*columns).collect()
    con = duckdb.connect()
    con.execute(f"CREATE TABLE {name} (doc_id BIGINT, zh VARCHAR)")
    con.executemany(f"INSERT INTO {name} VALUES (?, ?)", [list(x) for x in texts])
    again = con.execute(f"SELECT {', '.join(columns)} FROM ({_long_sums(_doubles(detector(DUCK, masked(DUCK, name))))})").fetchall()
    return sorted(map(tuple, rows)), sorted(again)


def test_every_detector_has_cases():
    assert set(CASES) == set(DETECTORS)


@pytest.mark.parametrize("name", CASES)
def test_by_hand(spark, name):
    cases = CASES[name] + [("", []), (None, [])]
    # What stands behind a URL without a blank between is masked to the next blank.
    cases = cases + [("https://a.b/" + t.replace(" ", "").replace("\n", ""), []) for t, found in cases[:1]]
    expected = sorted((i, *f) for i, (_, found) in enumerate(cases) for f in found)
    got, again = both(spark, DETECTORS[name], [(i, t) for i, (t, _) in enumerate(cases)])
    assert got == expected
    assert again == expected


def test_equal_and_null_ids_keep_their_places(spark):
    texts = [(1, "甲——乙——丙"), (1, "好甲——乙——丙"), (None, "甲——乙——丙")]
    spark.createDataFrame(texts, "doc_id long, zh string").createOrReplaceTempView("passage_docs")
    rows = spark.sql(DETECTORS["ai24_em_dash_places"](SPARK, "passage_docs")).collect()
    assert sorted((r.doc_id or 0, r.start) for r in rows) == [(0, 1), (1, 1), (1, 2)]


def test_domains(spark):
    text = "他是畫家之一，也是詩人之一。" + "好" * 140
    for domain, found in (("general", 1), ("technical", 0), ("literary", 1), ("news", 1)):
        assert len(both(spark, lambda d, s: one_of_density(d, s, domain), [(1, text)])[0]) == found


def test_masks_of_content_types(spark):
    """A code span and a fence hide what a detector counts."""
    docs = spark.createDataFrame([(1, "甲——乙`——`丙"), (2, "甲——乙——丙\n\n```\n丁——戊——己\n```\n"), (3, "甲——乙`——`丙——")], "doc_id long, text string")
    rows = structure.passages_detected(docs, "markdown", ["ai24_em_dash_places", "tr1_passive_places"]).collect()
    assert sorted((r.doc_id, r.detector, r.start, r.n) for r in rows) == [(2, "ai24_em_dash_places", 1, 2), (3, "ai24_em_dash_places", 1, 2)]


def test_long_texts(spark):
    """A sentence, a paragraph and a line of 96,000 characters, and as many short sentences, in each detector."""
    words = "不是而是雖然但是被之一你值得說到底歸根結底由此可見為什麼因為未來可期脈絡延伸更重要的是請——**總結與展望你以為嗎不容忽視"
    texts = [(1, words * 1600), (2, (words + "。") * 1600), (3, (words + "\n") * 1600), (4, (words + "\n\n") * 1600)]
    spark.createDataFrame(texts, "doc_id long, zh string").createOrReplaceTempView("long_docs")
    begun = time.time()
    for name, detector in DETECTORS.items():
        spark.sql(f"SELECT count(*) FROM ({_doubles(detector(SPARK, 'long_docs'))})").collect()
    assert time.time() - begun < 120


@pytest.mark.parametrize("name", ["ai29_slogan_places", "ai32_reveal_places"])
def test_a_reading_finds_what_sql_finds(spark, name):
    """Sentences, brackets and questions of random texts in both engines."""
    rnd = random.Random(5)
    said = ["到底為什麼？", "為什麼？", "因為不是錢，而是人。", "因為愛。", "不是甲乙丙，而是丁戊己。", "越快越好的事情。", "甲乙丙；丁戊己。", "但是，", "「", "」", "“", '"', "\n\n", "\n", "問：", "# 為什麼？\n", " ", "https://a.b/ ", "。", "）"]
    texts = [(i, "".join(rnd.choice(said) for _ in range(rnd.randint(2, 30)))) for i in range(300)]
    got, again = both(spark, DETECTORS[name], texts, "random_docs")
    assert got == again and len(got) > 10


def test_sentences_are_not_dealt_out(spark):
    """A text is cut, and its slogans are counted, where it is read."""
    spark.createDataFrame([(1, "甲")], "doc_id long, zh string").createOrReplaceTempView("passage_docs")
    for name, exchanges in (("ai29_slogan_places", 0), ("ai32_reveal_places", 1)):
        plan = spark.sql(_doubles(DETECTORS[name](SPARK, masked(SPARK, "passage_docs"))))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == exchanges
