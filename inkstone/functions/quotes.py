"""Quotation marks of a text: which become corner brackets, at which depth, and which brackets don't nest.

Marks are judged in pairs, paragraph by paragraph.  A shape whose two halves
differ pairs by a stack where each closing mark has an opening one before it;
else by turns, but for single marks, which may be apostrophes.  A pair becomes
brackets whole or not at all: its marks must belong to Chinese prose, and what
it holds must be Chinese or a single term.  A mark without a partner goes by its
neighbours, unless the paragraph holds marks that were passed over.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from .prose import CONTEXT_CLASS
from .spans import Span, overlaps

_BREAK = re.compile(r"\r?\n\r?\n")
_CONTEXT = re.compile(CONTEXT_CLASS)
_LATIN = re.compile("[A-Za-z]")
#: Blanks that may stand between a mark and its neighbour.
BLANKS = 3


class Shape(NamedTuple):
    opening: str
    closing: str
    #: Whether marks without a direction pair by turns.
    by_turns: bool
    #: Brackets at even and at odd depth.
    outer: str
    inner: str


SHAPES = (Shape("“", "”", True, "「」", "『』"), Shape("‘", "’", False, "『』", "『』"), Shape('"', '"', True, "「」", "「」"))
BRACKETS = {"」": "「", "』": "『", "》": "《"}


class Quote(NamedTuple):
    start: int
    found: str
    suggestion: str | None
    #: foreign mark, unclosed, unopened, interleaved, or inner without outer
    fault: str


def paragraphs(text: str) -> list[Span]:
    out, at = [], 0
    for m in _BREAK.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def _beside(text: str, a: int, b: int) -> bool:
    """Whether Chinese stands next to [a, b), over a few blanks at most."""
    left = re.search(rf"(\S)\s{{0,{BLANKS}}}\Z", text[max(0, a - BLANKS - 1) : a])
    right = re.match(rf"\s{{0,{BLANKS}}}(\S)", text[b : b + BLANKS + 1])
    return any(m is not None and _CONTEXT.match(m[1]) is not None for m in (left, right))


def _directed(openings: list[bool]) -> bool:
    """Whether the halves of a shape can be trusted: both occur, and none closes what wasn't opened."""
    depth = list(accumulate(1 if x else -1 for x in openings))
    return any(openings) and not all(openings) and min(depth) >= 0


def _pairs(openings: list[bool], by_turns: bool) -> list[tuple[int, int]]:
    if _directed(openings):
        stack, out = [], []
        for i, opening in enumerate(openings):
            if opening:
                stack.append(i)
            else:
                out.append((stack.pop(), i))
        return out
    return [(i, i + 1) for i in range(0, len(openings) - 1, 2)] if by_turns else []


class _Counts:
    """How many places of a kind lie in a span of a paragraph."""

    def __init__(self, places: list[int]) -> None:
        self.places = places

    def within(self, a: int, b: int) -> int:
        return bisect_right(self.places, b - 1) - bisect_right(self.places, a - 1)


def _converted(text: str, a: int, b: int, mask: list[Span], shape: Shape) -> list[tuple[int, bool]]:
    """(place, whether it opens) of a paragraph's marks that become brackets."""
    places, passed = [], False
    for i in (i for i in range(a, b) if text[i] in (shape.opening, shape.closing)):
        apostrophe = not shape.by_turns and any(c.isascii() and c.isalpha() for c in (text[i - 1 : i], text[i + 1 : i + 2]))
        if apostrophe or overlaps(mask, i, i + 1):
            passed = True
        else:
            places.append(i)
    if not places:
        return []
    opens = [shape.opening != shape.closing and text[i] == shape.opening or shape.opening == shape.closing for i in places]
    pairs = _pairs(opens if shape.opening != shape.closing else [True] * len(places), shape.by_turns)
    if not _directed(opens) or shape.opening == shape.closing:
        for i, j in pairs:
            opens[i], opens[j] = True, False
    seen = lambda p: _Counts([m.start() for m in p.finditer(text, a, b) if not overlaps(mask, m.start(), m.end()) and text[m.start()] not in shape])
    chinese, latin = seen(_CONTEXT), seen(_LATIN)
    keep = {}
    for i, j in pairs:
        x, y = places[i] + 1, places[j]
        outside = lambda c, x=x, y=y: c.within(a, x - 1) + c.within(y + 1, b)
        owned = outside(chinese) > 0 or not outside(latin)
        term = not re.search(r"\s", text[x:y]) and (_beside(text, x - 1, x) or _beside(text, y, y + 1))
        keep[i] = keep[j] = owned and (chinese.within(x, y) > 0 or term)
    return [(p, opens[k]) for k, p in enumerate(places) if (keep[k] if k in keep else not passed and _beside(text, p, p + 1))]


def _bracketed(marks: list[tuple[int, bool]], text: str, shape: Shape) -> list[Quote]:
    """Brackets of the converted marks of a paragraph, by depth."""
    spelt = [text[p] == shape.opening for p, _ in marks]
    turns = shape.by_turns and shape.opening != shape.closing and not _directed(spelt)
    depth, out = 0, []
    for k, (p, opening) in enumerate(marks):
        if turns:
            opening = k % 2 == 0 if k < len(marks) // 2 * 2 else spelt[k]
        if not opening:
            depth = max(0, depth - 1)
        out.append(Quote(p, text[p], (shape.outer if depth % 2 == 0 else shape.inner)[0 if opening else 1], "foreign mark"))
        depth += opening
    return out


def _nesting(text: str, a: int, b: int, mask: list[Span]) -> list[Quote]:
    """Brackets of a paragraph that don't close, weren't opened, cross, or are inner ones outside."""
    stack: list[tuple[str, int]] = []
    out = []
    for i in range(a, b):
        c = text[i]
        if c not in "「」『』《》" or overlaps(mask, i, i + 1):
            continue
        if c not in BRACKETS:
            stack.append((c, i))
        elif stack and stack[-1][0] == BRACKETS[c]:
            stack.pop()
            if c == "』" and not any(x == "「" for x, _ in stack):
                out.append(Quote(i, c, None, "inner without outer"))
        else:
            out.append(Quote(i, c, None, "interleaved" if stack else "unopened"))
    return out + [Quote(i, c, None, "unclosed") for c, i in stack]


def quotes(text: str, mask: list[Span]) -> list[Quote]:
    """What is wrong with the quotation marks of a text outside a mask, by place."""
    out = []
    for a, b in paragraphs(text):
        for shape in SHAPES:
            if shape.opening in text[a:b] or shape.closing in text[a:b]:
                out += _bracketed(_converted(text, a, b, mask, shape), text, shape)
        out += _nesting(text, a, b, mask)
    return sorted(out)
