"""Matches of a pattern in one text, from left to right, as both engines' regular expressions give them.

Patterns come as operators spell them (``\\x{...}``, ``\\z``, ``HELD``).  One that begins with MASK
reads URLs and mentions too: those are found by their marks (``://`` and ``@``), so that
what is left of the pattern says where the search may begin, and a text is not read
again from each of its letters.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

from .chars import MASKED, URL

#: Findings within these spans are no findings.
MASK = URL + "|@[a-zA-Z0-9_]+"
#: Behind a quantifier: what it took is never given back, so that the engine that would recurse for each round need not.
HELD = "␛"

_TAIL = re.compile(URL.split("://")[1], re.ASCII)
_HEAD = re.compile(URL.split("://")[0] + r"\Z", re.ASCII)
_NAME = re.compile("[a-zA-Z0-9_]+")
_HEAD_CHARS = 32
_FAR = 1 << 60


@lru_cache(maxsize=512)
def compiled(pattern: str) -> re.Pattern:
    """The pattern for this engine; classes are of ASCII, as in the others."""
    pattern = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)
    return re.compile(pattern.replace(r"\z", r"\Z").replace(HELD, "+"), re.ASCII)


class Led:
    """A pattern that is tried only where one of its first characters stands."""

    def __init__(self, lead: re.Pattern, pattern: re.Pattern) -> None:
        self.lead, self.pattern = lead, pattern

    def search(self, text: str, at: int = 0) -> re.Match | None:
        while (first := self.lead.search(text, at)) is not None:
            if (m := self.pattern.match(text, first.start())) is not None:
                return m
            at = first.end()
        return None

    def finditer(self, text: str) -> Iterator[re.Match]:
        at = 0
        while (m := self.search(text, at)) is not None:
            yield m
            at = max(m.end(), m.start() + 1)


class Masks:
    """URLs and mentions of a text, asked for from left to right."""

    def __init__(self, text: str) -> None:
        self.urls: list[tuple[int, int, int]] = []
        self.names: list[tuple[int, int]] = []
        i, end = text.find("://"), 0
        while i >= 0:
            # Within a URL the rest is the same for each mark.
            if i + 3 >= end and (tail := _TAIL.match(text, i + 3)):
                end = tail.end()
            if i + 3 < end:
                # The first place from which the scheme may be read, its mark, and the end.
                self.urls.append((_HEAD.search(text, max(0, i - _HEAD_CHARS), i).start(), i, end))
            i = text.find("://", i + 1)
        i = text.find("@")
        while i >= 0:
            name = _NAME.match(text, i + 1)
            if name:
                self.names.append((i, name.end()))
            i = text.find("@", i + 1)
        self.marks = [u[1] for u in self.urls]
        self.ats = [n[0] for n in self.names]

    def after(self, at: int) -> tuple[int, int]:
        """The first URL or mention that begins at a place or behind it."""
        i, j = bisect_left(self.marks, at), bisect_left(self.ats, at)
        url = (max(at, self.urls[i][0]), self.urls[i][2]) if i < len(self.urls) else (_FAR, _FAR)
        return min(url, self.names[j] if j < len(self.names) else (_FAR, _FAR))

    def all(self) -> Iterator[tuple[int, int]]:
        a, b = self.after(0)
        while a < _FAR:
            yield a, b
            a, b = self.after(b)


def merged(pattern: re.Pattern | Led, text: str, masks: Masks) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether a mask) of the matches of MASK or the pattern."""
    if not masks.urls and not masks.names:
        for m in pattern.finditer(text):
            yield m.start(), m.end(), False
        return
    m, mask = pattern.search(text), masks.after(0)
    while m is not None or mask[0] < _FAR:
        if m is not None and m.start() < mask[0]:
            a, b = m.span()
            yield a, b, False
            b = max(b, a + 1)
        else:
            a, b = mask
            yield a, b, True
        if m is not None and m.start() < b:
            m = pattern.search(text, b)
        if mask[0] < b:
            mask = masks.after(b)


def hits(text: str, pattern: str) -> Iterator[tuple[int, int]]:
    """(start, end) of all matches of a pattern."""
    if pattern == MASK:
        yield from Masks(text).all()
    elif pattern.startswith(MASK + "|"):
        for a, b, _ in merged(compiled(pattern[len(MASK) + 1 :]), text, Masks(text)):
            yield a, b
    else:
        for m in compiled(pattern).finditer(text):
            yield m.span()


def masked(text: str) -> str:
    """The text with each character of URLs and mentions masked."""
    out, at = [], 0
    for a, b in Masks(text).all():
        out += [text[at:a], MASKED * (b - a)]
        at = b
    return "".join([*out, text[at:]]) if out else text
