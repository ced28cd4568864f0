from hypothesis import given
from hypothesis import strategies as st

from inkstone.functions import prose, spans

pair = st.tuples(st.integers(0, 60), st.integers(0, 12)).map(lambda p: (p[0], p[0] + p[1]))


@given(st.lists(pair, max_size=20))
def test_merged_spans_are_sorted_apart_and_cover_the_same(items):
    out = spans.merged(items)
    assert all(a[1] < b[0] for a, b in zip(out, out[1:]))
    assert {x for a, b in out for x in range(a, b)} == {x for a, b in items for x in range(a, b)}


@given(st.lists(pair, max_size=12), pair)
def test_overlap_agrees_with_the_points(items, probe):
    held = [s for s in spans.merged(items) if s[0] < s[1]]
    points = {x for a, b in held for x in range(a, b)}
    assert spans.overlaps(spans.merged(held), *probe) == bool(points & set(range(*probe)))


def test_masks():
    text = "見 https://a.b/軟件，和@user_1軟件「網絡」一詞" + "。" * 50 + " ./src/軟件.py"
    cut = [text[a:b] for a, b in spans.plain_mask(text)]
    assert "https://a.b/軟件，和@user_1軟件" in cut and "網絡" in cut and "./src/軟件.py" in cut


def test_markdown_json_yaml_suppression_and_lang():
    assert spans.blanked("a `b` c", spans.markdown_mask("a `b` c")) == "a     c"
    text = '{"k": "軟件 {name}", "n": 1}'
    seen = spans.blanked(text, spans.json_mask(text))
    assert seen.strip() == "軟件" and spans.json_mask('{"k": "open') is None
    assert spans.yaml_mask("key: 軟件\n")[0] == (0, 4)
    lines = "a\n<!-- zhtw: disable -->\n軟件\n<!-- zhtw: enable -->\n軟件\n"
    assert spans.suppressed(lines) == [(2, lines.rindex("軟件"))]
    assert spans.suppressed("x // zhtw: disable-line") == [(0, 23)] and spans.suppressed("# zhtw: nonsense") == []
    html = '<p lang="en">one <b lang="zh-TW">二</b> three<br></p><p>四</p>'
    hidden = spans.blanked(html, spans.html_lang_mask(html))
    assert "one" not in hidden and "three" not in hidden and "二" in hidden and "四" in hidden


def test_shifted_spans_follow_edits():
    assert spans.shifted([(5, 7), (20, 22)], [(0, 2, "abc"), (10, 3, "")]) == [(6, 8), (18, 20)]


@given(st.text(alphabet="aéẹ́가가x", max_size=20))
def test_normal_form_and_places(text):
    import unicodedata

    out, places = prose.normalised(text)
    assert out == unicodedata.normalize("NFC", text)
    assert not places or (len(places) == len(out) + 1 and places == sorted(places))
