"""Spans of text that detectors leave alone, and arithmetic on spans (half-open, in code points)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

from . import blocks
from .chars import MASKED, URL

Span = tuple[int, int]

_URL_HEAD, _URL_TAIL = re.compile(URL.split("://")[0] + r"\Z"), re.compile(URL.split("://")[1])
_PATH = re.compile(r"(?:\.\.?/|(?<![\w/<])/)[^\s，。！？；「」<>]+")
_MENTION = re.compile(r"@[a-zA-Z0-9_]+")
_TERM = re.compile(r"[「『]([^「」『』]{1,12})[」』](?=一詞|這個詞|是(?:\w{0,2})的?(?:說法|用語))")
#: Escapes and placeholders in a JSON string: brackets around up to 64 characters of ASCII, heads of plurals, formats.
_PLACEHOLDER = re.compile(
    r"\\u[0-9a-fA-F]{0,4}|\\[\s\S]|\{\{[\x00-\x7c\x7e\x7f]{0,62}\}\}|\$(?=\{)|\$t\([\x00-\x28\x2a-\x7f]{0,62}\)|\{(?:[\x00-\x7a\x7c\x7e\x7f]{0,63}[{}])?|\}"
    r"|%%|%(?:\([\x00-\x28\x2a-\x7f]{0,62}\))?(?:\d+\$)?[-+0#]*[\d.]*[a-giopsuxA-GX@]"
)
_CONTAINER = re.compile(r"(?m)^[ \t]*:::[^\n]*")
_YAML_KEY = re.compile(r"(?:[^:\"'\n]|\"[^\"\n]*\"|'[^'\n]*'|:(?![ \t\r\n]|$))*:(?=[ \t\r\n]|$)")
_STRING = re.compile(r'"(?:[^"\\]|\\[\s\S])*"')
_COLON = re.compile(r"[ \t\r\n]*:")
#: Fixed value: the word before the colon of suppression comments, where a caller gives no other.
KEYWORD = "zhtw"
#: Primary language subtags of ISO 639 that count as Chinese, and elements by the rules of HTML.
CHINESE = frozenset("cdo cjy cmn cnp cpx csp czh czo gan hak hsn lzh mnp nan wuu yue zh".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "textarea", "title"))
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_ELEMENT = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LANG = re.compile(r"(?:^|\s)(?:xml:)?lang\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
DEPTH = 512


def merged(spans: list[Span]) -> list[Span]:
    """Sorted spans with overlapping and touching ones joined."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def overlaps(spans: list[Span], a: int, b: int) -> bool:
    """Whether [a, b) shares a code point with merged spans; an empty one never does."""
    i = bisect_left(spans, (b, -1)) - 1
    return a < b and i >= 0 and spans[i][1] > a


def blanked(text: str, spans: list[Span]) -> str:
    """Spans as spaces, line breaks kept."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], "".join("\n" if c == "\n" else " " for c in text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def shifted(spans: list[Span], edits: list[tuple[int, int, str]]) -> list[Span]:
    """Spans after edits (start, length, replacement) in order, none of them inside a span."""
    starts = [e[0] for e in edits]
    sums = [0]
    for _, n, to in edits:
        sums.append(sums[-1] + len(to) - n)
    move = lambda x: x + sums[bisect_right(starts, x - 1)]
    return [(move(a), move(a) + b - a) for a, b in spans]


def _urls(text: str) -> Iterator[Span]:
    """What ``URL`` finds, from its marks: the scheme is read back from them."""
    at, i = 0, text.find("://")
    while i >= 0:
        if i >= at and (tail := _URL_TAIL.match(text, i + 3)):
            yield _URL_HEAD.search(text, max(at, i - 32), i).start(), tail.end()
            at = tail.end()
        i = text.find("://", max(i + 1, at))


def plain_mask(text: str) -> list[Span]:
    """URLs, paths, mentions, and terms that are spoken about."""
    urls = list(_urls(text))
    ends = sorted(b for _, b in urls)
    out = list(urls)
    for m in _PATH.finditer(text):
        i = bisect_right(ends, m.start()) - 1
        if not (i >= 0 and m.start() - ends[i] <= 50) and not overlaps(merged(urls), *m.span()):
            out.append(m.span())
    held = merged(out)
    out += [m.span() for m in _MENTION.finditer(text) if not overlaps(held, *m.span())]
    return merged(out + [m.span(1) for m in _TERM.finditer(text)])


def markdown_mask(text: str, code: bool = True, quotes: bool = False) -> list[Span]:
    """Code, HTML, fence lines of containers, the structure of front matter, and what a foreign lang wraps.

    ``code``: whole code blocks; else their prose is looked at.  ``quotes``: quoted blocks too.
    """
    out, tags, front = [], [], blocks.front_matter(text)
    out += _yaml_structure(text, front)
    out += [m.span() for m in _CONTAINER.finditer(text)]
    for b in blocks.blocks(text):
        if b.kind == "html" or b.kind in ("fence", "code") and code or b.kind == "quote" and quotes:
            out.append((b.start, b.end))
        inline = blocks.inline_spans(text, b)
        out += inline
        tags += [(x, y) for x, y in [*inline, *([(b.start, b.end)] if b.kind == "html" else [])] if text[x] == "<"]
    if any(_LANG.search(text, x, y) for x, y in tags):
        out += html_lang_mask(blanked(text, _between(sorted(tags), len(text))))
    return merged(out)


def _between(spans: list[Span], end: int) -> list[Span]:
    """What merged spans leave of a text."""
    held = merged(spans)
    return [(a, b) for a, b in zip([0, *(b for _, b in held)], [*(a for a, _ in held), end]) if a < b]


def _key_end(line: str) -> int:
    """The place behind the colon of a YAML key: outside quotes, before white space or the line's end; 0 without one."""
    m = _YAML_KEY.match(line)
    return m.end() if m else 0


def _yaml_structure(text: str, end: int) -> list[Span]:
    """Dashes, keys and quote marks of front matter; values stay."""
    out, at = [], 0
    for line in text[:end].splitlines(keepends=True):
        if line.rstrip("\r\n") == "---":
            out.append((at, at + len(line)))
        elif _key_end(line):
            out.append((at, at + _key_end(line)))
        out += [(at + i, at + i + 1) for i, c in enumerate(line) if c in "\"'"]
        at += len(line)
    return out


def yaml_mask(text: str) -> list[Span]:
    """Keys with their colons."""
    out, at = [], 0
    for line in text.split("\n"):
        if end := _key_end(line):
            out.append((at, at + end))
        at += len(line) + 1
    return merged(out)


def json_mask(text: str) -> list[Span] | None:
    """All but string values, and placeholders in those; None if a string doesn't close."""
    strings, i = [], 0
    while (i := text.find('"', i)) >= 0:
        m = _STRING.match(text, i)
        if m is None:
            return None
        strings.append((i + 1, m.end() - 1))
        i = m.end()
    out, at = [], 0
    for a, b in strings:
        if not _COLON.match(text, b + 1):
            out += [(at, a), *(m.span() for m in _PLACEHOLDER.finditer(text, a, b))]
            at = b
    return merged([s for s in [*out, (at, len(text))] if s[0] < s[1]])


def html_lang_mask(html: str) -> list[Span]:
    """Text of elements whose nearest non-empty lang is not Chinese."""
    stack: list[tuple[str, bool]] = []
    out: list[Span] = []
    foreign, since, raw = False, 0, ""

    def turn(now: bool, at: int) -> None:
        nonlocal foreign, since
        if now != foreign:
            if foreign:
                out.append((since, at))
            foreign, since = now, at

    for m in _ELEMENT.finditer(html):
        closing, name, attributes = m[1], (m[2] or "").lower(), m[3] or ""
        if not name or raw and not (closing and name == raw):
            continue
        raw = ""
        if closing:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
            turn(stack[-1][1] if stack else False, m.start())
            continue
        while stack and stack[-1][0] in _CLOSES.get(name, ()):
            stack.pop()
        state = stack[-1][1] if stack else False
        lang = _LANG.search(attributes)
        if lang:
            tag = next((g for g in lang.groups() if g is not None), "").strip()
            state = bool(tag) and re.split(r"[-_]", tag)[0].lower() not in CHINESE
        turn(state, m.end())
        if name not in _VOID and not attributes.rstrip().endswith("/"):
            if len(stack) < DEPTH:
                stack.append((name, state))
            raw = name if name in _RAW else ""
    turn(False, len(html))
    return merged([s for s in out if s[0] < s[1]])


@lru_cache(maxsize=8)
def _comment(keyword: str) -> re.Pattern:
    return re.compile(rf"(?:<!--|//|#)[ \t]*{re.escape(keyword)}:[ \t]*(disable-line|disable-next-line|disable|enable)\b")


def suppressed(text: str, keyword: str = KEYWORD) -> list[Span]:
    """Lines switched off by comments with a keyword: a line, the next one, or a block that ends with the text if nothing else ends it."""
    out, at, block = [], 0, None
    next_line = False
    for line in text.splitlines(keepends=True):
        m = _comment(keyword).search(line)
        if next_line:
            out.append((at, at + len(line)))
            next_line = False
        if m:
            kind = m[1]
            if kind == "disable-line":
                out.append((at, at + len(line)))
            elif kind == "disable-next-line":
                next_line = True
            elif kind == "disable" and block is None:
                block = at
            elif kind == "enable" and block is not None:
                out.append((block, at + len(line)))
                block = None
        at += len(line)
    if block is not None:
        out.append((block, len(text)))
    return merged(out)


#: Content types, and what each leaves alone besides URLs, mentions and suppressed lines.
MASKS = {
    "plain": lambda text: [],
    "markdown": markdown_mask,
    "markdown_code": lambda text: markdown_mask(text, code=False),
    "yaml": yaml_mask,
    "json": json_mask,
    "html": html_lang_mask,
}


def mask_of(text: str, content_type: str = "plain") -> list[Span]:
    """All spans that are left alone in a text of a type."""
    return merged(plain_mask(text) + (MASKS[content_type](text) or []) + suppressed(text))


def visible(text: str, content_type: str = "plain") -> str:
    """The text with MASKED for each character that is left alone but line breaks; places stay."""
    out, at = [], 0
    for a, b in mask_of(text, content_type):
        out += [text[at:a], "\n".join(MASKED * len(x) for x in text[a:b].split("\n"))]
        at = b
    return "".join([*out, text[at:]])
