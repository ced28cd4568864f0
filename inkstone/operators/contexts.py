"""Operators that look at a finding's place: gates, blocks, depth, chunks, and page text.

All work on places from ``hits``; joins are by document with the overlap as a
further condition, so a document's findings meet its own spans only.
"""

from __future__ import annotations

from collections.abc import Callable

from ..dialect import Spark
from ..functions import lexicon as lx
from ..functions.chars import HAN
from ..plans.registered import Names
from .documents import sc3
from .lexical import RULES, alternation, issues, matches, merged
from .segments import paragraphs

H = f"[{HAN}]"
#: General words that the segmenter knows beside the rules' own forms.
GENERAL = tuple("我們 他們 城市 重要 問題 時代 可以 研究 報告 分析 決定 速度 科技 發展 工程 序列 大型 主要 任用 戶口 已經 已用 用戶名 影響".split())
WORDS = tuple(sorted({w for r in lx.RULES for w in (r[0], *r[1].split("/"), *r[6].split("/")) if len(w) > 1} | set(GENERAL), key=lambda w: (-len(w), w)))


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def seg6(d: Spark, t: Names) -> str:
    """Hits that a longer or neighbouring dictionary word cuts: it begins inside the hit and ends beyond it, or the reverse."""
    longer = f"(SELECT * FROM {d.hits(t.zh, 'zh', alternation(w for w in GENERAL))})"
    cut = "(w.start < m.start AND m.start < w.start + length(w.item) AND w.start + length(w.item) < m.start + length(m.item)) OR (m.start < w.start AND w.start < m.start + length(m.item) AND m.start + length(m.item) < w.start + length(w.item))"
    return f"SELECT m.doc_id, m.start, m.item AS found, min(w.item) AS word FROM {matches(d, t)} m JOIN {longer} w ON m.doc_id = w.doc_id AND ({cut}) GROUP BY m.doc_id, m.start, m.item"


def clauses(d: Spark, t: Names) -> str:
    """(doc_id, clause_ord, clause, item): rule forms by clause, each clause looked at once."""
    parts = f"(SELECT doc_id, {d.split('zh', '[。！？；]')} AS parts FROM {t.zh})"
    found = f"(SELECT doc_id, ord AS clause_ord, item AS clause, {d.all('item', alternation([r[0] for r in lx.RULES] + list(lx.EXCEPTIONS)))} AS fs FROM {d.explode(parts, 'parts')})"
    return f"(SELECT DISTINCT doc_id, clause_ord, clause, item FROM {d.explode(found, 'fs', 'doc_id, clause_ord, clause')})"


def seg7(d: Spark, t: Names) -> str:
    """Clues by tokens: of a rule's clues those that are words of the clause, each once."""
    tokens = d.all("clause", alternation(WORDS))
    has = "array_contains(tokens, x)" if d.name == "spark" else "list_contains(tokens, x)"
    rows = f"(SELECT c.doc_id, c.clause_ord, r.source, r.clues, {tokens} AS tokens FROM {clauses(d, t)} c JOIN (SELECT * FROM {merged()} WHERE clues <> '') r ON c.item = r.source)"
    return f"SELECT doc_id, clause_ord, source, {d.size(d.filter(d.split('clues', '/'), 'x', has))} AS clue_count FROM {rows}"


def lex6(d: Spark, t: Names) -> str:
    """Gates of a rule in order: configuration, longer form, clues, deletion; the first that stops it, or none."""
    clue = d.size(d.filter(d.split("clues", "/"), "x", "x <> source AND instr(clause, x) > 0")) + " > 0"
    rows = f"(SELECT c.doc_id, c.clause, r.* FROM {clauses(d, t)} c JOIN {merged()} r ON c.item = r.source)"
    verdict = f"CASE WHEN tags = 'optional' THEN 'configuration' WHEN clues <> '' AND NOT ({clue}) THEN 'clues' WHEN target = '' AND kind = 'ai_filler' THEN 'deletion' WHEN target = '' THEN 'no suggestion' ELSE 'passes' END"
    return f"SELECT doc_id, source, {verdict} AS gate, count(*) AS n FROM {rows} GROUP BY doc_id, source, {verdict}"


def exc7(d: Spark, t: Names) -> str:
    """Block boundaries of Markdown: headings and rules outside lists and quotes, with their places."""
    return f"SELECT doc_id, start, item FROM {d.hits(t.zh, 'zh', '(?m)^ {0,3}(#{1,6}[ ]|---+[ ]*$|[*][*][*]+[ ]*$|___+[ ]*$)')}"


def pre5(d: Spark, t: Names) -> str:
    """Facts of a text in one scan: script counts, lines, borders between ideographs and Latin letters."""
    only = lambda a, b: "".join(x for x, y in zip(a, b) if x != y)
    s, tr = only(lx.SIMPLIFIED, lx.TRADITIONAL), only(lx.TRADITIONAL, lx.SIMPLIFIED)
    return f"SELECT doc_id, {d.count('zh', f'[{s}]')} AS simplified, {d.count('zh', f'[{tr}]')} AS traditional, {d.count('zh', '[' + chr(92) + 'n]')} + 1 AS lines, {d.count('zh', H + '[A-Za-z]')} + {d.count('zh', '[A-Za-z]' + H)} AS borders FROM {t.zh}"


def src6(d: Spark, t: Names) -> str:
    """Visible text of pages: scripts, styles, comments and tags go; its length and digest."""
    visible = d.sub("html", r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^<>]*>", " ")
    plain = d.sub(visible, r"\s+", " ")
    return f"SELECT page_id, length(trim({plain})) AS n_chars, {d.sha(f'trim({plain})')} AS digest FROM {t.pages}"


def ort4(d: Spark, t: Names) -> str:
    """Marks that end a Latin clause and stay as they are: ASCII of up to 512 characters before it, two words or more, one of them in lower case."""
    # The mark is optional, so that a run without one is not read again from each of its places.
    runs = f"(SELECT * FROM {d.hits(t.zh, 'zh', '[A-Za-z0-9 ()/_-]+[,.;:?!]?')} WHERE {d.has('item', '[,.;:?!]$')})"
    return f"SELECT doc_id, count(*) AS runs, sum(CASE WHEN length(item) <= 512 AND {d.count('item', '[A-Za-z]+')} >= 2 AND {d.has('item', '(^|[ ])[a-z]')} THEN 1 ELSE 0 END) AS guarded FROM {runs} GROUP BY doc_id"


def ort7(d: Spark, t: Names) -> str:
    """Quotes by depth within their paragraph: an opening one counts up, a closing one down; even depths take 「」, odd ones 『』."""
    marks = d.hits(f"(SELECT doc_id, ord AS para, item AS body FROM {paragraphs(d, t.zh)})", "body", "[A-Za-z0-9]’[A-Za-z]|[“”‘’「」『』]", "doc_id, para")
    # An apostrophe is no mark, and a closing one without an opening one leaves the depth at 0.
    marks = f"(SELECT * FROM {marks} WHERE length(item) = 1)"
    step = "CASE WHEN item IN ('“', '‘', '「', '『') THEN 1 ELSE -1 END"
    over = "OVER (PARTITION BY hit_row ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    summed = f"SELECT *, sum({step}) {over} AS total FROM {marks}"
    opened = f"SELECT doc_id, para, start, item, total - least(0, min(total) {over}) - CASE WHEN item IN ('“', '‘', '「', '『') THEN 1 ELSE 0 END AS depth FROM ({summed})"
    to = "CASE WHEN item IN ('“', '‘', '「', '『') THEN CASE WHEN depth % 2 = 0 THEN '「' ELSE '『' END ELSE CASE WHEN depth % 2 = 0 THEN '」' ELSE '』' END END"
    return f"SELECT doc_id, para, start, item, CAST(depth AS BIGINT) AS depth, {to} AS suggestion FROM ({opened}) WHERE depth >= 0"


def ai16(d: Spark, t: Names) -> str:
    """Suspicious invisible characters: zero width space and word joiner always, a byte order mark but for the first place, a joiner but after an emoji."""
    found = d.hits(t.zh, "zh", r"[\x{1F300}-\x{1FAFF}]\x{200D}|[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]")
    return f"SELECT doc_id, start, length(item) AS n FROM {found} WHERE length(item) = 1 AND NOT (start = 0 AND {d.has('item', chr(92) + 'x{FEFF}')})"


def sc4(d: Spark, t: Names) -> str:
    """Part of punctuation in the machine score: how far the gaps' variation, weighted by counts, falls below 0.5, up to 0.1."""
    return f"SELECT doc_id, round(greatest(0, 0.5 - avg(cv * n) / avg(n)) / 0.5 * 0.1, 5) AS part FROM ({sc3(d, t)}) GROUP BY doc_id"


def da7(d: Spark, t: Names) -> str:
    """Chunks for a judge: up to 500 characters of the finding's paragraph around it."""
    body = f"(SELECT doc_id, ord AS para, item AS body FROM {paragraphs(d, t.zh)})"
    ambiguous = f"(SELECT * FROM {d.hits(body, 'body', alternation([r[0] for r in lx.RULES] + list(lx.EXCEPTIONS)), 'doc_id, para')} WHERE item IN ({quoted(sorted({r[0] for r in lx.RULES if '/' in r[1]}))}))"
    chunk = "substring(body, CAST(greatest(1, start - 249) AS INT), 500)"
    return f"SELECT m.doc_id, m.para, m.start, m.item AS found, length({chunk}) AS n_chars, {d.sha(chunk)} AS digest FROM {ambiguous} m JOIN {body} b ON m.doc_id = b.doc_id AND m.para = b.para"


def snk1(d: Spark, t: Names) -> str:
    """JSON lines: a finding a line with place, form, suggestion, kind and severity."""
    row = d.struct(offset="start", length="length(found)", found="found", suggestions="target", rule_type="kind", severity="severity")
    return f"SELECT doc_id, start, {row} AS line FROM {issues(d, t)}"


def snk5(d: Spark, t: Names) -> str:
    """Results of a SARIF log with their regions."""
    row = d.struct(ruleId="kind", level="CASE severity WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'note' END", charOffset="start", charLength="length(found)", message="concat(found, ' → ', target)")
    return f"SELECT doc_id, start, {row} AS result FROM {issues(d, t)}"


OPS: dict[str, Callable[[Spark, Names], str]] = {
    "seg6_straddled_hits": seg6, "seg7_clue_tokens": seg7, "lex6_gates": lex6, "exc7_block_boundaries": exc7, "pre5_text_facts": pre5, "src6_page_text": src6, "ort4_latin_clause": ort4,
    "ort7_quote_depth": ort7, "ai16_suspicious_characters": ai16, "sc4_punctuation_part": sc4, "da7_semantic_chunk": da7, "snk1_json_lines": snk1, "snk5_sarif_results": snk5,
}
