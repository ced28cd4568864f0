"""Shapes on texts whose findings are written by hand: positives, near misses and masked ones, in both engines."""

import duckdb
import pytest

from inkstone.dialect import DUCK, SPARK
from inkstone.operators.shapes import SHAPES, SYMBOL_RUNS, copulas, findings
from inkstone.plans.registered import _doubles, _long_sums

#: (text, (start, found, suggestion) of each finding)
CASES = {
    "ort1_halfwidth_marks": [
        ("這是一個測試,請注意!", [(6, ",", "，"), (10, "!", "！")]), ("好,是,對.", [(1, ",", "，"), (3, ",", "，"), (5, ".", "。")]), ("共1,000元", []), ("圖!看![圖](a)", [(1, "!", "！")]), ("版本v1.2好.5", []),
        ("Visit our site, 你好", []), ("Hello, 你好", [(5, ",", "，")]),
    ],
    "ort2_parentheses": [("備註(說明)在此", [(2, "(說明)", "（說明）")]), ("函式(x) 好", []), ("好(說明\n)在", [])],
    "ort3_colon": [("注意:請看", [(2, ":", "：")]), ("時間:12", []), ("Note: 好", [(4, ":", "：")]), (": 好", [])],
    "ort6_quote_pairs": [("他說“你好”，然後離開。", [(2, "“你好”", "「你好」")]), ("He said “你好” then left.", []), ("說“hello”好", [])],
    "ort10_ellipsis": [("等等...好", [(2, "...", "……")]), ("a...好", [(1, "...", "……")]), ("好。。。", [(1, "。。。", "……")]), ("好…嗎", [(1, "…", "……")]), ("好……嗎", []), ("a=...好", [])],
    "ort11_cjk_latin_spacing": [("用A好", [(1, "", " "), (2, "", " ")]), ("用 A 好", [])],
    "ort11_space_by_fullwidth_mark": [("好 ，是", [(1, " ", "")]), ("好， 是", [(2, " ", "")]), ("好 是", [])],
    "ort11_fullwidth_digits": [("共１２個", [(1, "１２", "12")]), ("共12個", [])],
    "ai1_implication": [("換言之，這意味著改變。", [(5, "意味著", "也就是說")]), ("所謂改變意味著因此", [(4, "意味著", "表示")]), ("如果這樣，意味著失敗", [(5, "意味著", "代表")]), ("這意味著改變", [(1, "意味著", None)])],
    "ai17_tricolon": [("團結、奮鬥、創新。", [(0, "團結、奮鬥、創新", None)]), ("我們團結、奮鬥、創新。", []), ("一、二三、四", [])],
    "tr13_false_friends": [("實際上基本上如此", [(0, "實際上", None), (3, "基本上", None)]), ("實際上，基本上如此", []), ("基本上(basically)好", [(0, "基本上", None)]), ("基本上（好）", [])],
    "tr16_head_chain": [("理解的提升的發展", [(0, "理解的提升的發展", None)]), ("理解的提升", [])],
    "rh1_long_sentence": [("這" * 31 + "。", [(0, "這" * 8, None)]), ("這" * 30 + "。", []), (("這" * 10 + "，") * 4, [])],
    "ort5_enumeration_comma": [("我愛蘋果，香蕉，橘子。", [(0, "我愛蘋果，香蕉，橘子", "我愛蘋果、香蕉、橘子")]), ("他今天沒有來，我很難過。", [])],
    "ort9_range_mark": [("上午~下午，第3~五章", [(2, "~", "～"), (8, "~", "～")]), ("15~20 台北-高雄", [(8, "-", "～")]), ("第3-5章", [])],
    "ort11_repeated_fullwidth_mark": [("好！！真的，，，對", [(1, "！！", "！"), (5, "，，，", "，")]), ("好！真的？！", [])],
    "ort14_spaced_acronym": [("用C P U和", [(1, "C P U", "CPU")]), ("A cat", []), ("a C P U", [(2, "C P U", "CPU")])],
    "grm1_a_not_a_with_ma": [("你是不是要去嗎？", [(1, "是不是要去嗎", "是不是")]), ("你是不是要去？好嗎", []), ("可不可以嗎", [(0, "可不可以嗎", "可不可以")]), ("是不是他問嗎這樣說。", [])],
    "grm2_he_joining_clauses": [("他吃了和我說了", [(3, "和", "，")]), ("貓和狗", []), ("他到了和我一樣", [])],
    "grm3_bare_shi_adjective": [("他是忙。", [(0, "他是忙", "他很忙")]), ("這是好消息", []), ("我們是高興的", [(0, "我們是高興", "我們很高興")]), ("他是很忙", []), ("他們是累", [(0, "他們是累", "他們很累")])],
    "grm4_redundant_preposition": [("討論了關於環境", [(0, "討論了關於", "討論")]), ("影響健康到今天", [(0, "影響健康到", "影響")]), ("影響很多人到今天", [])],
    "grm5_nominalised_verb": [("我們進行了討論", [(2, "進行了討論", "討論")]), ("予以處理", [(0, "予以處理", "處理")]), ("敬啟者，予以處理，進行分析", [(9, "進行分析", "分析")]), ("進行一場長跑", [])],
    "grm6_verbose_action": [("他做出了決定", [(1, "做出了決定", "決定")]), ("作出承諾", [(0, "作出承諾", "承諾")]), ("做出一個大決定", [])],
    "grm7_dui_jinxing": [("請對資料進行分析。", [(1, "對資料進行分析", "分析資料")]), ("針對資料進行分析", []), ("對於資料進行分析", []), ("對資料，進行分析", []), ("對系統進行了測試", [(0, "對系統進行了測試", "測試系統")])],
    "grm8_double_attribution": [("根據研究顯示，", [(0, "根據研究顯示", "根據研究")]), ("根據說明書", []), ("根據研究的顯示器", []), ("根據，顯示", []), ("根據[報告]指出", [])],
    "ai3_passive_rewrite": [("已被廣泛使用", [(1, "被廣泛使用", "廣泛使用")]), ("被廣泛認為", [])],
    "ai4_didactic": [("他的故事告訴我們", [(1, "的故事告訴我們", None)]), ("這個故事告訴我們", []), ("他的故事。告訴我們", [])],
    "ai5_vague_exaggeration": [("領先業界十多年", []), ("領先業界約10年", [(0, "領先業界約10年", None)]), ("領先業界，2024年", [])],
    "ai18_negative_parallel": [("這不只是工具，而是夥伴", [(1, "不只是工具，而是", None)]), ("不只是工具。而是", [])],
    "ai20_significance_stamp": [("這奠定了理論基礎。", [(1, "奠定了理論基礎", None)]), ("奠定。理論基礎", [])],
    "ai21_era_opener": [("隨著科技不斷發展，", [(0, "隨著科技不斷發展", None)]), ("隨著科技進步", [])],
    "ai25_formulaic_despite": [("儘管有挑戰，仍然前進。好。", [(0, "儘管有挑戰，仍然前進。", None)]), ("儘管有挑戰。仍然", [])],
    "ai26_false_range": [("從傳統產業到科技業再到", [(0, "從傳統產業到科技業再到", None)]), ("從甲到乙再到丙", [])],
    "ai31_colon_reveal": [("關鍵在於：不是技術，是人。", [(0, "關鍵在於：不是技術，是人。", None)]), ("定義：不是技術，是人。", []), ("問題在於：技術。", [])],
    "ai35_fake_candor": [("好。說實話？不行", [(2, "說實話", None)]), ("我說實話？", []), ("說實話，不行", [])],
    "ai36_opening_announcement": [("廢話不多說，開始", [(0, "廢話不多說", None)]), ("他廢話不多說", [])],
    "tr2_abstract_subject": [("人口的減少導致問題。好", [(0, "人口的減少導致問題。", None)]), ("導致人口的減少。", [])],
    "tr3_conditional_sentence": [("我們就會出發，如果放晴。", [(7, "如果", None)]), ("如果明天放晴我們就會出發。", []), ("去如果", [])],
    "tr5_copula_classifier": [("他是一位很好的人", [(1, "是一位", None)]), ("他是一位老師", [])],
    "tr6_de_mixup": [("仔細的看書", [(0, "仔細的看", "仔細地看")]), ("仔細的人", [])],
    "tr7_de_chain": [("我的朋友的家的門的顏色，好", [(0, "我的朋友的家的門的顏色", None)]), ("我的朋友的家，的門的顏色", [])],
    "tr8_redundant_di": [("慢慢地走", [(0, "慢慢地", "慢慢")]), ("快樂地走", [])],
    "tr9_tense_markers": [("他在2024年曾已去過。", [(0, "他在2024年曾已去過。", None)]), ("第3章曾已去過", []), ("2024年去過", [])],
    "tr10_superlative_one_of": [("這是最重要的發現之一。", [(2, "最重要的發現之一", None)]), ("最傑出的畫家之一", []), ("最高之城之一", [])],
    "tr11_connectives": [("因為下雨了，所以我們", [(0, "因為下雨了，所以", None)]), ("當他到的時候", [(0, "當他到的時候", None)]), ("當時他到的時候", []), ("敬啟者，因為下雨，所以", []), ("因為下雨。所以", [])],
    "tr12_nominal_chain": [("政策的實施效率的提升", [(2, "的實施效率的提升", None)]), ("政策的實施和效率的提升", []), ("的實施，的提升", [])],
    "tr15_paired_connectives": [("雖然下雨，但是出門", [(0, "雖然下雨，但是", "下雨，但是")]), ("當他到的時候", [(0, "當他到的時候", "當他到")]), ("如果好，那麼走", [(0, "如果好，那麼", "如果好，")]), ("貴公司，如果好，那麼走", [])],
}
EVERYWHERE = [("", []), (None, [])]


def test_every_shape_has_cases():
    assert set(CASES) == set(SHAPES)


@pytest.mark.parametrize("name", CASES)
def test_by_hand(spark, name):
    cases = CASES[name] + EVERYWHERE
    # A copy behind a URL is masked.
    shape, first = SHAPES[name], next(c for c in cases if c[1])
    if not any(x.scan for x in (shape if isinstance(shape[0], tuple) else [shape])):
        head = "看 https://a.b/"
        cases = cases + [(head + first[0].replace(" ", ""), [])]
    expected = sorted((i, *f) for i, (_, found) in enumerate(cases) for f in found)
    spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "doc_id long, zh string").createOrReplaceTempView("shape_docs")
    columns = ("doc_id", "start", "found", "suggestion")
    rows = spark.sql(_doubles(findings(shape, SPARK, "shape_docs"))).select(*columns).collect()
    assert sorted(tuple(r) for r in rows) == expected
    con = duckdb.connect()
    con.execute("CREATE TABLE shape_docs (doc_id BIGINT, zh VARCHAR)")
    con.executemany("INSERT INTO shape_docs VALUES (?, ?)", [[i, x] for i, (x, _) in enumerate(cases)])
    assert sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({_long_sums(_doubles(findings(shape, DUCK, 'shape_docs')))})").fetchall()) == expected


def test_symbol_runs(spark):
    texts = {1: "wow!!! ok", 2: "### head", 3: "a --- b", 4: "  ===\nx***", 5: "a'''b", 6: "!!", 7: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, zh string").createOrReplaceTempView("symbol_docs")
    rows = spark.sql(findings(SYMBOL_RUNS, SPARK, "symbol_docs")).collect()
    assert sorted((r.doc_id, r.start, r.found) for r in rows) == [(1, 3, "!!!"), (3, 2, "---"), (4, 7, "***"), (5, 1, "'''")]


def test_copulas_near_technical_terms(spark):
    far = "這" * 27
    texts = {1: "系統擁有功能", 2: "他擁有功能", 3: "系統的擁有權", 4: f"系統{far}擁有", 5: f"作為{far[:24]}系統", 6: f"作為{far[:25]}系統", 7: "看https://a.b/擁有系統", 8: "他有所作為的系統", 9: None, 10: "擁有作為，API"}
    spark.createDataFrame(list(texts.items()), "doc_id long, zh string").createOrReplaceTempView("copula_docs")
    expected = [(1, 2, "擁有"), (5, 0, "作為"), (10, 0, "擁有"), (10, 2, "作為")]
    assert sorted((r.doc_id, r.start, r.found) for r in spark.sql(copulas(SPARK, "copula_docs")).collect()) == expected
    con = duckdb.connect()
    con.execute("CREATE TABLE copula_docs (doc_id BIGINT, zh VARCHAR)")
    con.executemany("INSERT INTO copula_docs VALUES (?, ?)", [list(x) for x in texts.items()])
    assert sorted(r[:3] for r in con.execute(_long_sums(copulas(DUCK, "copula_docs"))).fetchall()) == expected
