"""The blocks of a Markdown text, with their places (half-open, in code points).

One reading of the lines with a stack of open containers (quotes, list items).
A line first meets the open containers, then opens new ones, then belongs to a
leaf: heading, thematic break, fence, indented code, HTML, table or paragraph.
A line that no container claims may still go on with an open paragraph.
Backtick spans and tags are found inside the leaves that hold prose.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

Span = tuple[int, int]

_FENCE = re.compile(r"(`{3,})[^`\n]*$|(~{3,})[^\n]*$")
_HEADING = re.compile(r"(#{1,6})(?:[ \t]+|$)")
_UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
_BREAK = re.compile(r"([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ITEM = re.compile(r"([-+*]|(\d{1,9})[.)])(?=[ \t]|$)")
_RULE_ROW = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_TAG = re.compile(r"<!--[\s\S]*?-->|<\?[\s\S]*?\?>|</[a-zA-Z][a-zA-Z0-9-]*[ \t\n]*>|<[a-zA-Z][a-zA-Z0-9-]*(?:[ \t\n]+[a-zA-Z_:][\w.:-]*(?:[ \t\n]*=[ \t\n]*(?:[^ \t\n\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*[ \t\n]*/?>")
_WHOLE_TAG = re.compile(r"(?:</?[a-zA-Z][^<>]*>)[ \t]*$")
_TICKS = re.compile(r"`+")
# Elements that open a block of HTML, and those that end with their own closing tag.
BLOCK_ELEMENTS = frozenset(
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".split()
)
RAW_ELEMENTS = ("script", "pre", "style", "textarea")


@dataclass
class Block:
    kind: str
    start: int
    end: int
    #: Of a heading; containers around the block.
    level: int = 0
    depth: int = 0
    #: Where its prose stands, a span a line.
    prose: list[Span] = field(default_factory=list)
    #: (row, column, start, end) of a table.
    cells: list[tuple[int, int, int, int]] = field(default_factory=list)


def front_matter(text: str) -> int:
    """The end of leading YAML between two lines of three dashes; 0 without one."""
    opening = re.match(r"---\r?\n", text)
    closing = opening and re.compile(r"^---\r?(?:\n|\Z)", re.M).search(text, opening.end())
    return closing.end() if closing else 0


def _cells(text: str, a: int, b: int) -> list[Span]:
    """The cells of a table's row: between bars that no backslash precedes, without blanks around."""
    while a < b and text[a] in " \t":
        a += 1
    while b > a and text[b - 1] in " \t\r":
        b -= 1
    bars = [i for i in range(a, b) if text[i] == "|" and (i == a or text[i - 1] != "\\")]
    if bars and bars[0] == a:
        a, bars = a + 1, bars[1:]
    if bars and bars[-1] == b - 1:
        b, bars = b - 1, bars[:-1]
    out = []
    for i, j in zip([a, *(x + 1 for x in bars)], [*bars, b]):
        while i < j and text[i] in " \t":
            i += 1
        while j > i and text[j - 1] in " \t":
            j -= 1
        out.append((i, j))
    return out


def _html_end(rest: str, within: bool) -> re.Pattern | str | None:
    """What ends the block of HTML that a line begins: a pattern, or "" for a blank line; None if it begins none."""
    low = rest.lower()
    for name in RAW_ELEMENTS:
        if re.match(rf"<{name}(?:[ \t>]|$)", low):
            return re.compile(rf"</(?:{'|'.join(RAW_ELEMENTS)})>", re.I)
    for head, end in (("<!--", "-->"), ("<?", r"\?>"), ("<![CDATA[", r"\]\]>")):
        if rest.startswith(head):
            return re.compile(end)
    if re.match(r"<![a-zA-Z]", rest):
        return re.compile(">")
    m = re.match(r"</?([a-z][a-z0-9-]*)(?:[ \t/>]|$)", low)
    if m and (m[1] in BLOCK_ELEMENTS or not within and m[1] not in RAW_ELEMENTS and _WHOLE_TAG.match(rest)):
        return ""
    return None


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.out, self.stack = text, [], []
        #: The open leaf, and what ends it (fences and HTML).
        self.leaf: Block | None = None
        self.until: object = None

    def indent(self, i: int, end: int) -> tuple[int, int]:
        """Columns of white space from i on, and the place after it."""
        width = 0
        while i < end and self.text[i] in " \t":
            width += 1 if self.text[i] == " " else 4 - width % 4
            i += 1
        return width, i

    def past(self, i: int, end: int, columns: int) -> int:
        """The place ``columns`` of white space after i, or as many as there are."""
        width = 0
        while i < end and width < columns and self.text[i] in " \t":
            width += 1 if self.text[i] == " " else 4 - width % 4
            i += 1
        return i

    def close(self) -> None:
        if self.leaf is not None:
            self.out.append(self.leaf)
        self.leaf = self.until = None

    def drop(self, depth: int) -> None:
        """Closes the containers from ``depth`` on."""
        if len(self.stack) > depth:
            self.close()
            self.out += [block for _, block in self.stack[depth:]]
            del self.stack[depth:]

    def start(self, kind: str, a: int, b: int, **more: object) -> Block:
        self.close()
        self.leaf = Block(kind, a, b, depth=len(self.stack), **more)
        return self.leaf

    def line(self, start: int, end: int) -> None:
        text = self.text
        i, matched, blank = start, 0, False
        for columns, _ in self.stack:
            width, j = self.indent(i, end)
            blank = j == end or text[j] == "\r"
            if columns is None:
                if width > 3 or j >= end or text[j] != ">":
                    break
                i = self.past(j + 1, end, 1)
            elif not blank:
                if width < columns:
                    break
                i = self.past(i, end, columns)
            matched += 1
        for columns, block in self.stack[:matched]:
            if columns is None or text[i:end].strip():
                block.end = end
        leaf = self.leaf
        width, j = self.indent(i, end)
        rest = text[j:end].rstrip("\r")
        blank = not rest
        if leaf is not None and matched == len(self.stack) and self.until is not None:
            self.inside(leaf, start, end, width, rest, blank, i)
            return
        if leaf is not None and leaf.kind == "paragraph" and matched < len(self.stack) and not blank and not self.opens(width, rest):
            # A paragraph goes on although its containers aren't named again.
            leaf.prose.append((j, end))
            for block in (leaf, *(b for _, b in self.stack)):
                block.end = end
            return
        self.drop(matched)
        while not blank and width <= 3:
            item = _ITEM.match(rest)
            if rest[0] == ">":
                self.close()
                self.stack.append((None, Block("quote", start, end, depth=len(self.stack))))
                i = self.past(j + 1, end, 1)
            elif item and not _BREAK.match(rest) and self.may_open(item, rest):
                self.close()
                inner, k = self.indent(j + item.end(), end)
                # The content's column: at most four after the marker, one before indented code or on an empty item.
                gap = 1 if inner > 4 or k >= end else inner
                self.stack.append((width + item.end() + gap, Block("item", start, end, depth=len(self.stack))))
                i = self.past(j + item.end(), end, gap)
            else:
                break
            width, j = self.indent(i, end)
            rest = text[j:end].rstrip("\r")
            blank = not rest
        self.leaf_line(start, i, j, end, width, rest, blank)

    def may_open(self, item: re.Match, rest: str) -> bool:
        within = self.leaf is not None and self.leaf.kind == "paragraph" and self.leaf.depth == len(self.stack)
        return not within or (item[2] in (None, "1") and rest[item.end() :].strip() != "")

    @staticmethod
    def opens(width: int, rest: str) -> bool:
        """Whether a line outside a paragraph's containers begins a block of its own."""
        return width <= 3 and bool(rest[0] == ">" or any(p.match(rest) for p in (_HEADING, _FENCE, _BREAK, _ITEM)) or _html_end(rest, False) is not None)

    def inside(self, leaf: Block, start: int, end: int, width: int, rest: str, blank: bool, i: int) -> None:
        """A further line of a fence or of HTML."""
        if isinstance(self.until, str) and leaf.kind == "html":
            if blank:
                self.close()
                return
        leaf.end = end
        if leaf.kind == "fence":
            mark = str(self.until)
            if width <= 3 and re.match(rf"{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", rest):
                self.close()
            else:
                leaf.prose.append((i, end))
        elif not isinstance(self.until, str) and self.until.search(self.text, start, end):
            self.close()

    def leaf_line(self, start: int, i: int, j: int, end: int, width: int, rest: str, blank: bool) -> None:
        text, leaf = self.text, self.leaf
        if blank:
            if leaf is not None and leaf.kind != "code":
                self.close()
            return
        paragraph = leaf is not None and leaf.kind == "paragraph"
        if width >= 4 and not paragraph:
            if leaf is None or leaf.kind != "code":
                leaf = self.start("code", start if not self.stack else i, end)
            leaf.end = end
            leaf.prose.append((i, end))
            return
        if leaf is not None and leaf.kind == "code":
            self.close()
            leaf = None
        underline = _UNDERLINE.match(rest) if paragraph and width <= 3 else None
        heading, fence, html = _HEADING.match(rest), _FENCE.match(rest), _html_end(rest, paragraph)
        if width > 3:
            heading = fence = html = None
        if underline and not (len(leaf.prose) == 1 and "|" in text[slice(*leaf.prose[0])] and "|" in rest):
            leaf.kind, leaf.level, leaf.end = "heading", 1 if underline[1][0] == "=" else 2, end
            self.close()
        elif heading:
            a = j + heading.end()
            body = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", text[a:end].rstrip("\r")).rstrip()
            self.start("heading", j, end, level=len(heading[1]), prose=[(a, a + len(body))])
            self.close()
        elif _BREAK.match(rest) and width <= 3:
            self.start("rule", j, end)
            self.close()
        elif fence:
            self.start("fence", j, end)
            self.until = fence[1] or fence[2]
        elif html is not None:
            self.start("html", j, end)
            self.until = html
            if not isinstance(html, str) and html.search(text, j + 1, end):
                self.close()
        elif paragraph and len(leaf.prose) == 1 and _RULE_ROW.match(rest) and "|" in text[slice(*leaf.prose[0])] + rest and len(_cells(text, *leaf.prose[0])) == len(_cells(text, j, end)):
            leaf.kind, leaf.end = "table", end
            leaf.cells = [(0, k, a, b) for k, (a, b) in enumerate(_cells(text, *leaf.prose[0]))]
            leaf.level = 1
        elif leaf is not None and leaf.kind == "table":
            wide = sum(1 for c in leaf.cells if c[0] == 0)
            leaf.cells += [(leaf.level, k, a, b) for k, (a, b) in enumerate(_cells(text, j, end)[:wide])]
            leaf.level += 1
            leaf.end = end
            leaf.prose.append((j, end))
        elif paragraph:
            leaf.prose.append((j, end))
            leaf.end = end
        else:
            self.start("paragraph", j, end, prose=[(j, end)])


def blocks(text: str) -> list[Block]:
    """Leaves and containers of a text in order of their beginnings; front matter is a block of its own."""
    reader, at = _Reader(text), front_matter(text)
    if at:
        reader.out.append(Block("front", 0, at))
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        reader.line(at, end)
        at = end + 1
    reader.drop(0)
    reader.close()
    return sorted(reader.out, key=lambda b: (b.start, -b.end, b.depth))


def section_starts(text: str) -> list[int]:
    """Beginnings of the lines at which a section ends: headings and breaks outside all containers."""
    return sorted({text.rfind("\n", 0, b.start) + 1 for b in blocks(text) if b.kind in ("heading", "rule") and not b.depth})


def inline_spans(text: str, block: Block) -> list[Span]:
    """Backtick spans and tags in the prose of a block."""
    if block.kind not in ("heading", "paragraph", "table") or not block.prose:
        return []
    a, b = block.prose[0][0], block.prose[-1][1]
    ticks = [m.span() for m in _TICKS.finditer(text, a, b)]
    places: dict[int, list[int]] = {}
    for k, (x, y) in enumerate(ticks):
        places.setdefault(y - x, []).append(k)
    out, k = [], 0
    next_of = {n: 0 for n in places}
    while k < len(ticks):
        x, y = ticks[k]
        if (x - a) and text[x - 1] == "\\" and (x - 1 == a or text[x - 2] != "\\"):
            x += 1
        same = places.get(y - x, [])
        n = next_of.get(y - x, 0)
        while n < len(same) and same[n] <= k:
            n += 1
        next_of[y - x] = n
        if y > x and n < len(same):
            out.append((x, ticks[same[n]][1]))
            k = same[n] + 1
        else:
            k += 1
    code, tags = out, []
    for m in _TAG.finditer(text, a, b):
        i = bisect_left(code, (m.end(), -1)) - 1
        if i < 0 or code[i][1] <= m.start():
            tags.append(m.span())
    return sorted(code + tags)
