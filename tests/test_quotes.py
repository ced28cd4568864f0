"""Quotation marks by hand: pairs, owners, terms, apostrophes, depth and nesting."""

import time

import pytest

from inkstone.functions.quotes import quotes
from inkstone.functions.spans import mask_of
from inkstone.operators.structure import quote_faults

#: A text and what becomes of it; "=" stands for the text itself.
CONVERTED = [
    ("他說“你好”，然後離開。", "他說「你好」，然後離開。"),
    ("他說\"你好\"，然後離開。", "他說「你好」，然後離開。"),
    ("He said “你好” then left.", "="),
    ("He said \"你好\" then left.", "="),
    ("“敏捷開發”", "「敏捷開發」"),
    ("他引用了原句：“Do one thing.”", "="),
    ("他引用了原句：“Do one thing.”，這是哲學。", "="),
    ("請按“Enter”鍵", "請按「Enter」鍵"),
    ("設定\"font-size\"屬性", "設定「font-size」屬性"),
    ("他說“甲“乙”丙”好", "他說「甲『乙』丙」好"),
    ("他說“甲‘乙’丙”好", "他說「甲『乙』丙」好"),
    ("她說“再見“好", "她說「再見」好"),
    ("她說”再見“好", "她說「再見」好"),
    ("他說“你好”。\n\n她說“再見“好", "他說「你好」。\n\n她說「再見」好"),
    ("他說你好”", "他說你好」"),
    ("他說“你好", "他說「你好"),
    ("it’s 好", "="),
    ("Python’s 語法", "="),
    ("他說‘it’s 好’", "="),
    ("他說‘你好’", "他說『你好』"),
    ("他說\"https://example.com\"好", "="),
    ("全是 “英文 quote” 嗎", "全是 「英文 quote」 嗎"),
    ("plain \"text\" only", "="),
    ("甲\"乙\"丙\"丁\"戊", "甲「乙」丙「丁」戊"),
    ("甲\"乙\"丙\"丁", "甲「乙」丙\"丁".replace("丙\"", "丙「")),
    ("", "="),
]


@pytest.mark.parametrize("text, expected", CONVERTED)
def test_conversion(text, expected):
    out, at = [], 0
    for q in quotes(text, mask_of(text)):
        if q.fault == "foreign mark":
            out += [text[at : q.start], q.suggestion]
            at = q.start + 1
    assert "".join([*out, text[at:]]) == (text if expected == "=" else expected)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("他說「你好」", []),
        ("他說「甲『乙』丙」", []),
        ("『乙』", [(2, "』", "inner without outer")]),
        ("「甲", [(0, "「", "unclosed")]),
        ("甲」", [(1, "」", "unopened")]),
        ("「甲『乙」丙』", [(4, "」", "interleaved"), (6, "』", None)]),
        ("「甲\n\n乙」", [(0, "「", "unclosed"), (5, "」", "unopened")]),
        ("《書名」》", [(3, "」", "interleaved")]),
        ("《書》「甲《乙》」", []),
        ("「「甲」", [(0, "「", "unclosed")]),
    ],
)
def test_nesting(text, expected):
    found = [(q.start, q.found, q.fault) for q in quotes(text, []) if q.fault != "foreign mark"]
    if expected and expected[-1][2] is None:
        # After the crossing, the outer bracket stays open and the inner one closes.
        assert found[0] == (0, "「", "unclosed") and found[1] == expected[0]
    else:
        assert found == expected


def test_masked_marks_and_rows(spark):
    docs = spark.createDataFrame([(1, "他說`“好”`"), (2, None), (None, "他說“好”"), (None, "他說“好”")], "doc_id long, text string")
    rows = quote_faults(docs, "markdown").collect()
    assert sorted((str(r.doc_id), r.start, r.suggestion) for r in rows) == [("None", 2, "「"), ("None", 2, "「"), ("None", 4, "」"), ("None", 4, "」")]


def test_time_follows_length():
    for piece in ("“好”", "“好", "\"a", "「", "」", "’s ", "‘好’ ", "\n\n“好”"):
        took = []
        for size in (20_000, 160_000):
            text, began = piece * (size // len(piece)), time.thread_time()
            quotes(text, [])
            took.append(time.thread_time() - began)
        assert took[1] < 30 * max(took[0], 0.02), (piece, took)
