"""Sequential work on one text: normal form, words, findings, overlaps, fixes."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate
from operator import eq

from . import lexicon as lx
from .chars import CONTEXT, HAN
from .spans import mask_of, merged, overlaps

_py = lambda p: re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), p)
HAN_CLASS, CONTEXT_CLASS = f"[{_py(HAN)}]", f"[{_py(CONTEXT)}]"
WINDOW = 40


def normalised(text: str) -> tuple[str, list[int]]:
    """NFC, and for each of its code points (and its end) the place in the original; empty if nothing changed."""
    if unicodedata.is_normalized("NFC", text):
        return text, []
    out, places, i = [], [], 0
    while i < len(text):
        j = i + 1
        # A piece ends before the next starter that composes with nothing before it.
        while j < len(text) and (unicodedata.combining(text[j]) or len(unicodedata.normalize("NFC", text[i : j + 1])) <= len(unicodedata.normalize("NFC", text[i:j]))):
            j += 1
        piece = unicodedata.normalize("NFC", text[i:j])
        out.append(piece)
        places += [i] * len(piece)
        i = j
    return "".join(out), [*places, len(text)]


def forward(places: list[int], a: int, b: int) -> tuple[int, int]:
    """The range of the normal form that holds the original's [a, b); ``places`` as of ``normalised``, empty if nothing changed."""
    return (bisect_right(places, a) - 1 if a < places[-1] else len(places) - 1, bisect_left(places, b)) if places else (a, b)


_PIECES = re.compile(r"[^。！？，、\s,.]*[。！？，、\s,.]?")


@lru_cache(maxsize=1 << 14)
def _changes(left: str, right: str) -> tuple[tuple[int, int, str], ...]:
    """What differs between two pieces; pieces repeat, and most texts differ in the same ones."""
    return tuple((i, j, right[k:n]) for op, i, j, k, n in SequenceMatcher(None, left, right, autojunk=False).get_opcodes() if op != "equal")


def edits(text: str, to: str) -> set[tuple[int, int, str]]:
    """Spans of a text with their replacements: pieces up to a mark or space are paired first, characters within those that differ."""
    if text == to:
        return set()
    old, new = (_PIECES.findall(x) for x in (text, to))
    if len(old) == len(new):
        blocks = [(i, i + 1, i, i + 1) for i, (a, b) in enumerate(zip(old, new)) if a != b]
    else:
        blocks = [(a, b, c, d) for op, a, b, c, d in SequenceMatcher(None, old, new).get_opcodes() if op != "equal"]
    starts, out = [0, *accumulate(map(len, old))], set()
    for a, b, c, d in blocks:
        left, right = "".join(old[a:b]), "".join(new[c:d])
        if left != right:
            # Long pieces aren't kept.
            changes = _changes if len(left) + len(right) < 256 else _changes.__wrapped__
            out |= {(starts[a] + i, starts[a] + j, said) for i, j, said in changes(left, right)}
    return out


def edit_score(text: str, expected: str, got: str) -> tuple[int, int, int]:
    """(edits found, edits expected, edits in both) of two corrections of a text."""
    want, have = edits(text, expected), edits(text, got)
    return len(have), len(want), len(want & have)


@lru_cache(maxsize=1)
def words() -> dict[str, int]:
    """The segmenter's dictionary: forms and clues of rules, with how common single characters are taken to be."""
    out: dict[str, int] = {}
    for source, target, *_, clues, _ in lx.RULES:
        for w in (source, *target.split("/"), *clues.split("/")):
            if w:
                out.setdefault(w, 1)
    for w in ("我們", "他們", "城市", "重要", "問題", "時代", "可以", "研究", "報告", "分析", "決定", "速度", "科技", "發展"):
        out.setdefault(w, 5)
    for w in "的了是在和有不我他她它這那也就都而及與著過":
        out[w] = 10
    return out


def _index(known: dict[str, int]) -> tuple[dict[str, list[str]], re.Pattern | None]:
    """Words of two characters or more by their first one, longest first; and what finds a first one."""
    heads: dict[str, list[str]] = {}
    for w in sorted((w for w in known if len(w) > 1), key=len, reverse=True):
        heads.setdefault(w[0], []).append(w)
    return heads, re.compile("[" + "".join(map(re.escape, heads)) + "]") if heads else None


@lru_cache(maxsize=1)
def _own_index() -> tuple[dict[str, list[str]], re.Pattern | None]:
    return _index(words())


def _picked(text: str, known: dict[str, int], heads: dict[str, list[str]], head: re.Pattern | None) -> Iterator[tuple[int, str]]:
    """(place, word) of the words of two characters or more; only where one begins is there anything to choose."""

    def at(i: int) -> list[str]:
        return [*(w for w in heads.get(text[i], ()) if text.startswith(w, i)), text[i]]

    i = 0
    while head is not None and (first := head.search(text, i)) is not None:
        i = first.start()
        if len(at(i)) == 1:
            i += 1
            continue
        best = None
        for a in at(i):
            for b in at(i + len(a)) if i + len(a) < len(text) else [""]:
                k = i + len(a) + len(b)
                for c in at(k) if b and k < len(text) else [""]:
                    chunk = [w for w in (a, b, c) if w]
                    total = sum(map(len, chunk))
                    mean = total / len(chunk)
                    rank = (total, mean, -sum((len(w) - mean) ** 2 for w in chunk), sum(known.get(w, 0) for w in chunk if len(w) == 1), len(a))
                    if best is None or rank > best[0]:
                        best = rank, a
        if len(best[1]) > 1:
            yield i, best[1]
        i += len(best[1])


def segmented(text: str, dictionary: dict[str, int] | None = None) -> list[tuple[int, str, bool]]:
    """Words by chunks of three: most characters, then longest average, least variance, commonest single characters, longest first word.

    A character outside the dictionary is a word of its own.
    """
    known = words() if dictionary is None else dictionary
    out, at = [], 0
    for i, word in _picked(text, known, *(_own_index() if dictionary is None else _index(known))):
        out += [(k, text[k], text[k] in known) for k in range(at, i)]
        out.append((i, word, True))
        at = i + len(word)
    return out + [(k, text[k], text[k] in known) for k in range(at, len(text))]


def word_counts(text: str) -> tuple[int, int]:
    """(words, those that the dictionary has) of ``segmented``, without a row for each."""
    known, n = words(), len(text)
    single = [w for w in known if len(w) == 1]
    found = sum(map(text.count, single))
    for _, word in _picked(text, known, *_own_index()):
        n -= len(word) - 1
        found += 1 - sum(c in known for c in word)
    return n, found


@lru_cache(maxsize=1)
def _rules() -> tuple[re.Pattern, dict[str, tuple]]:
    last: dict[str, tuple] = {}
    for i, r in enumerate(lx.RULES):
        if r[0] not in last or r[5] >= last[r[0]][1][5]:
            last[r[0]] = i, r
    forms = sorted({*last, *lx.EXCEPTIONS}, key=lambda f: (-len(f), f))
    return re.compile("|".join(map(re.escape, forms))), last


_CASE = re.compile(r"(?i)(?<![A-Za-z0-9_.\-])(" + "|".join(lx.CASES) + r")(?![A-Za-z0-9_.\-])")
_H, _C = HAN_CLASS, CONTEXT_CLASS
#: (pass, kind, severity, pattern, replacement or None); a pattern begins with what it looks for, so that a text is passed over quickly
PASSES = tuple(
    (name, kind, severity, re.compile(pattern), to)
    for name, kind, severity, pattern, to in (
        ("comma", "punctuation", 2, rf",(?:(?<={_C},)(?!\d)|(?<!\d,)(?={_C}))", "，"),
        ("stop", "punctuation", 2, rf"\.(?<={_C}\.)(?![\w.])", "。"),
        ("question", "punctuation", 2, rf"\?(?<={_C}\?)", "？"),
        ("exclamation", "punctuation", 2, rf"!(?<={_C}!)(?!\[)", "！"),
        ("semicolon", "punctuation", 2, rf";(?<={_C};)", "；"),
        ("colon", "punctuation", 2, rf":(?<={_C}:)(?!\d)", "："),
        ("parentheses", "punctuation", 2, rf"\((?<={_C}\()[^()\n]{{1,512}}\)(?={_C})", None),
        ("range", "punctuation", 1, rf"~(?:(?<=[\d{_py(HAN)}]~)(?={_H})|(?<={_H}~)(?=\d))|-(?<={_H}-)(?={_H})", "～"),
        ("ellipsis", "punctuation", 2, rf"\.\.\.(?:(?<={_C}\.\.\.)\.*|\.*(?={_C}))|。。。+", "……"),
        ("doubled mark", "spacing", 1, r"([，！？；：])\1+", None),
        ("full-width digits", "spacing", 1, r"[\uFF10-\uFF19]+", None),
        ("repeated unit", "repetition", 1, rf"({_H}{_H}{_H}?)\1", None),
        ("repeated word", "repetition", 1, r"(?i)\b([A-Za-z0-9]{3,})(?:[ \t]+|[ \t]*\n[ \t]*)\1\b", None),
        ("spaced acronym", "spacing", 1, r"[A-Z](?<!\w[A-Z])(?: [A-Z]){2,}\b", None),
        ("invisible", "ai_style", 2, r"[\u200B\u2060]", ""),
    )
)


#: Characters outside ASCII that a search without case takes for letters of it.
_ODD = re.compile("[ſKıİ]")
_WORD = re.compile("[a-z0-9]+")


def _may_hold_case(text: str) -> bool:
    """Whether the names of ``_CASE`` can stand in a text."""
    low = text.lower()
    return any(c.lower() in low for c in lx.CASES) or _ODD.search(text) is not None


def _may_repeat(text: str) -> bool:
    """Whether a Latin word can stand twice in a row."""
    found = _WORD.findall(text.lower())
    return any(map(eq, found, found[1:])) or _ODD.search(text) is not None


def _window(text: str, a: int, b: int) -> str:
    """Up to 40 characters on each side, within the sentence and paragraph."""
    left = re.split(r"[。！？；]|\n\s*\n", text[max(0, a - WINDOW) : a])[-1]
    right = re.split(r"[。！？；]|\n\s*\n", text[b : b + WINDOW])[0]
    return left + "\0" + right


def found(text: str, content_type: str = "plain") -> list[tuple]:
    """Candidates (start, length, form, suggestions, kind, severity, pass, order), in order of the passes."""
    mask = mask_of(text, content_type)
    pattern, rules = _rules()
    out: list[tuple] = []

    def add(a: int, b: int, suggestions: list[str], kind: str, severity: int, name: str) -> None:
        if not overlaps(mask, a, b):
            out.append((a, b - a, text[a:b], suggestions, kind, severity, name, len(out)))

    for m in pattern.finditer(text):
        if m[0] in lx.EXCEPTIONS:
            continue
        _, (_, target, kind, severity, english, _, clues, _) = rules[m[0]]
        if clues and not any(c in _window(text, *m.span()) for c in clues.split("/") if c != m[0]):
            continue
        suggestions = target.split("/") if target else [""] if kind == "ai_filler" else [english] if english else []
        add(*m.span(), suggestions, kind, severity, "spelling")
    proper = {c.lower(): c for c in lx.CASES}
    for m in _CASE.finditer(text) if _may_hold_case(text) else ():
        if m[0] != proper[m[0].lower()]:
            add(*m.span(), [proper[m[0].lower()]], "case", 1, "casing")
    for name, kind, severity, p, to in PASSES:
        for m in p.finditer(text) if name != "repeated word" or _may_repeat(text) else ():
            if name == "parentheses":
                suggestion = ["（" + m[0][1:-1] + "）"]
            elif name == "doubled mark":
                suggestion = [m[1]]
            elif name == "full-width digits":
                suggestion = [unicodedata.normalize("NFKC", m[0])]
            elif name == "spaced acronym":
                suggestion = [m[0].replace(" ", "")]
            elif name.startswith("repeated"):
                suggestion = [m[1]] if len(m[1]) >= 3 else []
            else:
                suggestion = [to]
            add(*m.span(), suggestion, kind, severity, name)
    return out


def resolved(candidates: list[tuple]) -> list[tuple]:
    """Disjoint findings: longer before shorter, then more severe, then first; by start."""
    taken: list[tuple[int, int]] = []
    out = []
    for c in sorted(candidates, key=lambda c: (-c[1], -c[5], c[0], c[7])):
        if not overlaps(taken, c[0], c[0] + max(1, c[1])):
            taken = merged([*taken, (c[0], c[0] + c[1])]) if c[1] and len(taken) < 64 else _inserted(taken, (c[0], c[0] + c[1]))
            out.append(c)
    return sorted(out, key=lambda c: (c[0], -c[5], c[7]))


def _inserted(spans: list[tuple[int, int]], span: tuple[int, int]) -> list[tuple[int, int]]:
    from bisect import insort

    insort(spans, span)
    return spans


def applied(text: str, findings: list[tuple]) -> tuple[str, int, int, int]:
    """(text, applied, skipped, declined): one suggestion is written, several decline, none is skipped; an edit that meets the one before it is skipped."""
    parts, at, done, skipped, declined = [], 0, 0, 0, 0
    for start, length, form, suggestions, kind, *_ in findings:
        if len(suggestions) > 1:
            declined += 1
        if len(suggestions) != 1 or suggestions[0] == form or start < at:
            skipped += 1
            continue
        parts += [text[at:start], suggestions[0]]
        at = start + length
        done += 1
    return "".join([*parts, text[at:]]), done, skipped, declined
