"""Conversion against a plain walk, and what masks keep."""

import json
import random

import pytest

from inkstone.operators.conversion import Dictionary, convert, converted, own_stages, script_shares


def walk(text, forms):
    out, at = [], 0
    while at < len(text):
        form = max((f for f in forms if text.startswith(f, at)), key=len, default=None)
        out.append(forms[form] if form else text[at])
        at += len(form) if form else 1
    return "".join(out)


def test_longest_forms_against_a_plain_walk():
    r = random.Random(4)
    for _ in range(300):
        word = lambda: "".join(r.choice("甲乙丙") for _ in range(r.randint(1, 4)))
        forms = {word(): word() for _ in range(r.randint(0, 8))}
        text = "".join(r.choice("甲乙丙丁") for _ in range(r.randint(0, 30)))
        assert Dictionary(forms).apply(text)[0] == walk(text, forms)


@pytest.mark.parametrize(
    "kind, text, expected",
    [
        ("plain", "优化软件的质量", "優化軟體的品質"),
        ("plain", "數據機與數據", "數據機與資料"),
        ("plain", "看https://a.b/软件 软件", "看https://a.b/软件 軟體"),
        ("markdown", "`软件` 软件", "`软件` 軟體"),
        ("markdown_code", "```\n软件\n```", "```\n軟體\n```"),
        ("yaml", "软件: 软件", "软件: 軟體"),
        ("json", '{"软件": "软件", "b": ["数据", "{软件}", "%s软件\\n数据"]}', '{"软件": "軟體", "b": ["資料", "{軟體}", "%s軟體\\n資料"]}'),
        ("json", '{"a": "{name}软件{{软件}}"}', '{"a": "{name}軟體{{軟體}}"}'),
        ("html", '<p lang="en">软件</p>软件', '<p lang="en">软件</p>軟體'),
        ("plain", "", ""),
        ("plain", None, None),
    ],
)
def test_stages_and_masks(spark, kind, text, expected):
    docs = spark.createDataFrame([(1, text), (None, text)], "doc_id long, text string")
    rows = convert(docs, own_stages(spark), kind).collect()
    assert [r.text for r in rows] == [expected] * 2
    if kind == "json":
        assert list(json.loads(rows[0].text)) == list(json.loads(text))


def test_script_shares(spark):
    docs = spark.createDataFrame([(1, "优化軟"), (1, "質"), (2, None), (3, "abc")], "doc_id long, text string")
    rows = script_shares(docs, own_stages(spark)[0]).collect()
    assert sorted((r.doc_id, r.simplified, r.traditional) for r in rows) == [(1, 0, 1), (1, 1, 1), (2, 0, 0), (3, 0, 0)]


def test_bounds():
    with pytest.raises(ValueError):
        Dictionary({"x": "y" * (1 << 24)})
    assert converted("好", [Dictionary({})], "plain") == ("好", 0)
