"""Markdown blocks, masks of content types and detectors behind them, by hand."""

import pytest

from inkstone.functions.blocks import blocks, inline_spans, section_starts
from inkstone.functions.spans import MASKS, html_lang_mask, json_mask, mask_of, merged, visible, yaml_mask
from inkstone.operators import structure
from inkstone.operators.shapes import SHAPES
from tests.test_shapes import CASES

#: A text, and (kind, level, depth, source) of each of its blocks.
BLOCKS = [
    ("# A\n\ntext\n===\n", [("heading", 1, 0, "# A"), ("heading", 1, 0, "text\n===")]),
    ("two\nlines\n---\n", [("heading", 2, 0, "two\nlines\n---")]),
    ("a\n\n---\n***\n- - -\n", [("paragraph", 0, 0, "a"), ("rule", 0, 0, "---"), ("rule", 0, 0, "***"), ("rule", 0, 0, "- - -")]),
    ("#no\n####### no\n", [("paragraph", 0, 0, "#no\n####### no")]),
    ("## t ##\n", [("heading", 2, 0, "## t ##")]),
    ("```py\n# x\n```\nafter", [("fence", 0, 0, "```py\n# x\n```"), ("paragraph", 0, 0, "after")]),
    ("~~~\n```\n~~~~\n", [("fence", 0, 0, "~~~\n```\n~~~~")]),
    ("````\n```\nopen", [("fence", 0, 0, "````\n```\nopen")]),
    ("``` a`b\ntext", [("paragraph", 0, 0, "``` a`b\ntext")]),
    ("    code\n\n    more\nx", [("code", 0, 0, "    code\n\n    more"), ("paragraph", 0, 0, "x")]),
    ("text\n    on", [("paragraph", 0, 0, "text\n    on")]),
    ("> # q\n> para\nlazy\n\nout", [("quote", 0, 0, "> # q\n> para\nlazy"), ("heading", 1, 1, "# q"), ("paragraph", 0, 1, "para\nlazy"), ("paragraph", 0, 0, "out")]),
    ("> a\n# b", [("quote", 0, 0, "> a"), ("paragraph", 0, 1, "a"), ("heading", 1, 0, "# b")]),
    ("> ```\n> x\ny", [("quote", 0, 0, "> ```\n> x"), ("fence", 0, 1, "```\n> x"), ("paragraph", 0, 0, "y")]),
    ("- a\n- b\n  c\n\n  d", [("item", 0, 0, "- a"), ("paragraph", 0, 1, "a"), ("item", 0, 0, "- b\n  c\n\n  d"), ("paragraph", 0, 1, "b\n  c"), ("paragraph", 0, 1, "d")]),
    ("- a\n\n      code\n", [("item", 0, 0, "- a\n\n      code"), ("paragraph", 0, 1, "a"), ("code", 0, 1, "    code")]),
    ("1. a\n   > q\n2. b", [("item", 0, 0, "1. a\n   > q"), ("paragraph", 0, 1, "a"), ("quote", 0, 1, "   > q"), ("paragraph", 0, 2, "q"), ("item", 0, 0, "2. b"), ("paragraph", 0, 1, "b")]),
    ("text\n2. no item\n1. item", [("paragraph", 0, 0, "text\n2. no item"), ("item", 0, 0, "1. item"), ("paragraph", 0, 1, "item")]),
    ("- # h\n", [("item", 0, 0, "- # h"), ("heading", 1, 1, "# h")]),
    ("<div>\nx\n\ny", [("html", 0, 0, "<div>\nx"), ("paragraph", 0, 0, "y")]),
    ("<!-- a\n\nb -->\ny", [("html", 0, 0, "<!-- a\n\nb -->"), ("paragraph", 0, 0, "y")]),
    ("<script>\n\nx</script> z\ny", [("html", 0, 0, "<script>\n\nx</script> z"), ("paragraph", 0, 0, "y")]),
    ("text\n<span>\n", [("paragraph", 0, 0, "text\n<span>")]),
    ("<span>\ntext", [("html", 0, 0, "<span>\ntext")]),
    ("|a|b|\n|-|:-:|\n|c|\n\nx", [("table", 2, 0, "|a|b|\n|-|:-:|\n|c|"), ("paragraph", 0, 0, "x")]),
    ("a|b\n---\n", [("heading", 2, 0, "a|b\n---")]),
    ("---\nt: x\n---\n# h", [("front", 0, 0, "---\nt: x\n---\n"), ("heading", 1, 0, "# h")]),
    ("a\r\n\r\nb", [("paragraph", 0, 0, "a\r"), ("paragraph", 0, 0, "b")]),
    ("", []),
]


@pytest.mark.parametrize("text, expected", BLOCKS)
def test_blocks_by_hand(text, expected):
    assert [(b.kind, b.level if b.kind in ("heading", "table") else 0, b.depth, text[b.start : b.end]) for b in blocks(text)] == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a `b` c ``d ` e`` f", ["`b`", "``d ` e``"]),
        ("\\`a` b`", ["` b`"]),
        ("`open", []),
        ("x <b class='y'>z</b> <!-- c --> 1 < 2", ["<b class='y'>", "</b>", "<!-- c -->"]),
        ("`<b>` <i>", ["`<b>`", "<i>"]),
        ("a `b\nc` d", ["`b\nc`"]),
        ("# h `c`", ["`c`"]),
    ],
)
def test_inline_spans(text, expected):
    assert [text[a:b] for x in blocks(text) for a, b in inline_spans(text, x)] == expected


def test_sections_end_at_headings_and_breaks_outside_containers():
    text = "intro\n\n## a\n> # no\n\n```\n# no\n```\n\n***\ntitle\n===\n- # no\n"
    assert [text[a:].split("\n")[0] for a in section_starts(text)] == ["## a", "***", "title"]
    assert section_starts("---\na: b\n---\nx") == []


def test_cells_and_headings(spark):
    text = "| 軟件 | a\\|b |\n| --- | --- |\n| x |  |\n\n標題 `c`\n---\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.line, r.col, r.cell) for r in structure.table_cells(docs).collect()] == [(0, 0, "軟件"), (0, 1, "a\\|b"), (1, 0, "x"), (1, 1, "")]
    assert [(r.level, r.title) for r in structure.headings(docs).collect()] == [(2, "標題 `c`")]


def test_yaml_keys():
    text = 'title: 軟件: x\n"a: b": c\n- k: v\nurl: http://x\nno:colon\n'
    assert [text[a:b] for a, b in yaml_mask(text)] == ["title:", '"a: b":', "- k:", "url:"]


@pytest.mark.parametrize(
    "text, seen",
    [
        ('{"軟件": "用軟件"}', "用軟件"),
        ('{"a": ["軟", "件"], "b": 3}', "軟件"),
        ('{"a": "好\\n{name}軟{{x}}件%s%1$d100%"}', "好軟件100%"),
        ('{"a": "{n, plural, one {軟件} other {件}}"}', "軟件 other 件"),
        ('{"a": "{軟件}$t(key)${x}\\u8edf"}', "軟件"),
        ('{"a" \n: "好"}', "好"),
    ],
)
def test_json_values(text, seen):
    held = json_mask(text)
    assert "".join(c for i, c in enumerate(text) if not any(a <= i < b for a, b in held)) == seen
    assert json_mask('{"a": "open') is None


def test_markdown_mask():
    text = "---\ntitle: \"軟件\"\n---\n:::note\n軟件 `軟件` <b>軟件</b>\n:::\n\n    軟件\n\n<p lang=\"en\">x</p>\n\n文 <i lang=\"ja\">日本</i> 字\n"
    left = "".join(c for i, c in enumerate(text) if not any(a <= i < b for a, b in merged(MASKS["markdown"](text))))
    assert left.replace("\n", "") == " 軟件軟件  軟件文  字"
    assert "    軟件" in "".join(c for i, c in enumerate(text) if not any(a <= i < b for a, b in merged(MASKS["markdown_code"](text))))


def test_visible_keeps_places():
    text = "看 https://a.b/c 與 `軟\n件` 軟件"
    seen = visible(text, "markdown")
    assert len(seen) == len(text) and seen.count("\n") == 1 and seen.index("軟件") == text.index("軟件")
    assert all(visible("", kind) == "" and mask_of("", kind) == [] for kind in MASKS)


#: Each content type with a place that is masked and one that is not.
HIDE = {
    "markdown": "`{}`",
    "yaml": "{}: a",
    "json": '{{"{}": 1}}',
    "plain": "https://a.b/{}",
    "html": '<p lang="en">{}</p>',
}


@pytest.mark.parametrize("kind", HIDE)
def test_every_detector_behind_every_mask(spark, kind):
    """The first finding of each detector is found in the open and not in a masked place."""
    rows, n = [], 0
    names = list(SHAPES)
    for name in names:
        text = next(c[0] for c in CASES[name] if c[1])
        if any(c in text for c in "\n\"':`") or kind == "plain" and " " in text:
            continue
        hidden = HIDE[kind].format(text)
        if kind == "json":
            open_ = '{"k": "' + text + '"}'
        elif kind == "yaml":
            open_ = "k: " + text
        elif kind == "html":
            open_ = '<p lang="zh">' + text + "</p>"
        else:
            open_ = text
        rows += [(2 * n, hidden), (2 * n + 1, open_)]
        n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = structure.detected(docs, kind, names).select("doc_id", "found").collect()
    texts = dict(rows)
    hits = {r.doc_id for r in found}
    assert {d for d in hits if d % 2 == 0} == set(), [texts[d] for d in hits if d % 2 == 0]
    assert len({d for d in hits if d % 2}) >= n - 6, [texts[d] for d in texts if d % 2 and d not in hits]


def test_html_scopes():
    html = '<div lang="en">a<p lang="zh-TW">軟件</p>b</div>軟件'
    assert [html[a:b] for a, b in html_lang_mask(html)] == ["a<p lang=\"zh-TW\">", "</p>b"]


def test_long_markdown_in_linear_time():
    import time

    for piece in ("`", "`a", "<a ", "> ", "- ", "#", "|a", "* ", "<", "`` `", "- a\n", "> a\n", "a\n===\n", "\\`", "<!--", "[", "1. "):
        took = []
        for size in (20_000, 160_000):
            text, began = piece * (size // len(piece)), time.thread_time()
            mask_of(text, "markdown")
            took.append(time.thread_time() - began)
        assert took[1] < 30 * max(took[0], 0.02), (piece, took)
