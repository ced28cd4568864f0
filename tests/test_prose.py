import re

from hypothesis import given
from hypothesis import strategies as st

from inkstone.functions import prose

FRAGMENTS = ["軟件", "內存,", "用戶.", "程序運行", " the the ", "https://x.y/軟件 ", "（好)", "......", "12:30", "C P U", "非常非常", "，，", "\n\n", "Github", "。", "信息素", "１２"]


def forms(text):
    return [(c[2], c[3]) for c in prose.resolved(prose.found(text))]


def test_goldens():
    assert ("軟件", ["軟體"]) in forms("這個軟件很好")
    assert forms("信息素") == []  # a longer form covers it
    assert ("程序", ["程式"]) in forms("這個程序運行很快") and not any(f == "程序" for f, _ in forms("法律程序。運行"))
    assert ("視頻", ["影音"]) in forms("看視頻")  # the last layer's suggestion
    assert ("Github", ["GitHub"]) in forms("在 Github 上") and forms("my_github_repo") == []
    assert (",", ["，"]) in forms("你好,世界") and forms("a, b") == [] and forms("1,000") == []
    assert ("非常非常", []) in forms("非常非常好")
    assert ("the the", ["the"]) in forms("in the the end")


@given(st.lists(st.sampled_from(FRAGMENTS), max_size=12).map("".join))
def test_findings_are_disjoint_and_slices_and_fixes_splice(text):
    out = prose.resolved(prose.found(text))
    assert all(text[s : s + n] == f for s, n, f, *_ in out)
    assert all(a[0] + a[1] <= b[0] for a, b in zip(out, out[1:]))
    fixed, done, skipped, declined = prose.applied(text, out)
    assert done + skipped == len(out) and declined <= skipped
    if not done:
        assert fixed == text


@given(st.text(alphabet="我們研究問題的軟件用戶x", max_size=16))
def test_words_cover_the_text(text):
    assert "".join(w for _, w, _ in prose.segmented(text)) == text


def test_words_take_the_most_characters():
    assert [w for _, w, _ in prose.segmented("我們研究問題")] == ["我們", "研究", "問題"]
    assert [w for _, w, _ in prose.segmented("文件夾", {"文件": 1, "文件夾": 1})] == ["文件夾"]


def test_words_are_counted_without_a_row_for_each():
    for text in ("軟件文件夾和數據的質量", "的了是 abc 用戶我們", "", "計算機運行程序" * 50):
        words = prose.segmented(text)
        assert prose.word_counts(text) == (len(words), sum(known for *_, known in words))


def test_equal_pieces_are_compared_once(monkeypatch):
    compared = []

    class Counted(prose.SequenceMatcher):
        def __init__(self, *args, **more):
            compared.append(args)
            super().__init__(*args, **more)

    monkeypatch.setattr(prose, "SequenceMatcher", Counted)
    text = "新軟件甲，" * 500
    assert prose.edits(text, text.replace("軟件", "軟體")) == {(5 * i + 2, 5 * i + 3, "體") for i in range(500)}
    assert len(compared) <= 1


_H, _C = prose.HAN_CLASS, prose.CONTEXT_CLASS
#: The passes as their rules say them.
PLAIN = {
    "comma": rf"(?<={_C}),(?!\d)|(?<!\d),(?={_C})", "stop": rf"(?<={_C})\.(?![\w.])(?<!\.\.)", "question": rf"(?<={_C})\?", "exclamation": rf"(?<={_C})!(?!\[)", "semicolon": rf"(?<={_C});",
    "colon": rf"(?<={_C}):(?!\d)", "parentheses": rf"(?<={_C})\([^()\n]{{1,512}}\)(?={_C})", "range": rf"(?<=[\d{_H[1:-1]}])~(?={_H})|(?<={_H})~(?=\d)|(?<={_H})-(?={_H})",
    "ellipsis": rf"(?<={_C})\.{{3,}}|\.{{3,}}(?={_C})|。{{3,}}", "repeated unit": rf"({_H}{{2,3}})\1", "repeated word": r"(?i)\b([A-Za-z0-9]{3,})(?:[ \t]+|[ \t]*\n[ \t]*)\1\b", "spaced acronym": r"\b[A-Z](?: [A-Z]){2,}\b",
}


@given(st.text(alphabet="甲乙。，,.;:?!~-()[1 \nAb"))
def test_passes_find_what_their_rules_say(text):
    for name, _, _, pattern, _ in prose.PASSES:
        if name in PLAIN:
            assert [m.span() for m in pattern.finditer(text)] == [m.span() for m in re.finditer(PLAIN[name], text)]
    if re.search(PLAIN["repeated word"], text):
        assert prose._may_repeat(text)


def test_a_text_is_not_searched_for_what_it_cannot_hold():
    assert not prose._may_repeat("one two three") and prose._may_repeat("one One")
    assert not prose._may_hold_case("git hub") and prose._may_hold_case("GITHUB")
