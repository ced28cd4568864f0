"""Vocabulary: rule layers, matching, gates, casing, coverage and conversion.

Matching is one ordered alternation, longest form first, which is leftmost-longest
without overlaps.  Rule attributes join late, after matching, from a table of a
few dozen rows that the optimiser broadcasts by its size.
"""

from __future__ import annotations

from collections.abc import Callable

from ..dialect import Spark
from ..functions import lexicon as lx
from ..functions.chars import HAN
from ..functions.matching import MASK
from ..plans.registered import Names
from .segments import CUT, lines

RULES = lx.values(tuple((i, *r) for i, r in enumerate(lx.RULES)), "rule_id, source, target, kind, severity, english, layer, clues, tags", "r")


def merged() -> str:
    """Layers merged: of rules with one source the last layer's counts."""
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY layer DESC, rule_id DESC) AS k FROM {RULES}) WHERE k = 1)"


def alternation(forms) -> str:
    return "(" + "|".join(sorted(set(forms), key=lambda f: (-len(f), f))) + ")"


MATCH = alternation([r[0] for r in lx.RULES] + list(lx.EXCEPTIONS))
#: Masks and forms in one alternation: a mask swallows what stands in it, and so does an exception form.
PLACES = f"{MASK}|{MATCH}"


def matches(d: Spark, t: Names, text: str = "zh", source: str = "") -> str:
    """(doc_id, ord, start, item) of all hits outside URLs and mentions; exception forms match but are no hits."""
    forms = ", ".join(f"'{r}'" for r in sorted({r[0] for r in lx.RULES} - set(lx.EXCEPTIONS)))
    return f"(SELECT * FROM {d.hits(source or t.zh, text, PLACES)} WHERE item IN ({forms}))"


def issues(d: Spark, t: Names) -> str:
    """Findings with their places and the attributes of their rules."""
    return f"(SELECT doc_id, ord, start, item AS found, rule_id, target, kind, severity, english, tags, clues FROM {matches(d, t)} m JOIN {merged()} r ON m.item = r.source)"


def lex1(d: Spark, t: Names) -> str:
    """Hits by document and form."""
    return f"SELECT doc_id, item AS found, count(*) AS n FROM {matches(d, t)} GROUP BY doc_id, item"


def lex2(d: Spark, t: Names) -> str:
    """Findings by document and kind, with the highest severity."""
    return f"SELECT doc_id, kind, count(*) AS n, max(severity) AS severity FROM {issues(d, t)} GROUP BY doc_id, kind"


def lex5(d: Spark, t: Names) -> str:
    """Absorbers: exception forms found in texts."""
    return f"SELECT doc_id, {d.count('zh', alternation(lx.EXCEPTIONS))} AS n FROM {t.zh}"


def lex8(d: Spark, t: Names) -> str:
    """Matches that a longer form covers: 文件 inside 文件夾."""
    return f"SELECT doc_id, {d.count('zh', '文件夾')} AS covered, {d.count('zh', '文件')} - {d.count('zh', '文件夾')} AS bare FROM {t.zh}"


def lex9(d: Spark, t: Names) -> str:
    """Clue gate, at the grain of a clause: a rule with clues needs one of them in the clause around its hit."""
    gated = sorted({r[0] for r in lx.RULES if r[6]}, key=lambda f: (-len(f), f))
    clauses = f"(SELECT doc_id, {d.split('zh', '[。！？；]')} AS parts FROM {t.zh})"
    pieces = f"(SELECT doc_id, ord, item AS clause FROM {d.explode(clauses, 'parts')} WHERE {d.has('item', '|'.join(gated))})"
    # Hits by term equality with the rules; each clause is looked at once.
    hit = f"(SELECT h.doc_id, h.clause_ord, h.clause, r.source, r.clues FROM (SELECT DISTINCT doc_id, clause_ord, clause, item FROM {d.explode(f'(SELECT doc_id, ord AS clause_ord, clause, {d.all(chr(99) + chr(108) + chr(97) + chr(117) + chr(115) + chr(101), alternation([r[0] for r in lx.RULES] + list(lx.EXCEPTIONS)), 1)} AS fs FROM {pieces})', 'fs', 'doc_id, clause_ord, clause')}) h JOIN (SELECT * FROM {merged()} WHERE clues <> '') r ON h.item = r.source)"
    with_clue = d.size(d.filter(d.split("clues", "/"), "x", "x <> source AND instr(clause, x) > 0")) + " > 0"
    return f"SELECT doc_id, source, count(*) AS clauses, sum(CASE WHEN {with_clue} THEN 1 ELSE 0 END) AS with_clue FROM {hit} GROUP BY doc_id, source"


def lex16(d: Spark, t: Names) -> str:
    """Names in other than their written form: whole identifiers, dotted labels and file names are read as one."""
    inner = f"(SELECT doc_id, {d.all('zh', '[A-Za-z0-9_.' + chr(92) + '-]+')} AS found FROM {t.zh})"
    return f"SELECT e.doc_id, e.item AS found, c.term, count(*) AS n FROM {d.explode(inner, 'found')} e JOIN {lx.values(lx.CASES, 'term', 'c')} c ON lower(e.item) = lower(c.term) WHERE e.item <> c.term GROUP BY e.doc_id, e.item, c.term"


def lex17(d: Spark, t: Names) -> str:
    """Coverage: rules that are active, and those with a finding."""
    return f"SELECT (SELECT count(*) FROM {merged()}) AS active, count(DISTINCT rule_id) AS matched FROM {issues(d, t)}"


def pre4(d: Spark, t: Names) -> str:
    """Script by the majority of characters that only one script has."""
    only_s = "".join(a for a, b in zip(lx.SIMPLIFIED, lx.TRADITIONAL) if a != b)
    only_t = "".join(b for a, b in zip(lx.SIMPLIFIED, lx.TRADITIONAL) if a != b)
    n = lambda s: d.count("zh", f"[{s}]")
    return f"SELECT doc_id, s, t, CASE WHEN s > t THEN 'simplified' WHEN t > s THEN 'traditional' ELSE 'unknown' END AS script FROM (SELECT doc_id, {n(only_s)} AS s, {n(only_t)} AS t FROM {t.zh})"


def pre7(d: Spark, t: Names) -> str:
    """Simplified characters converted, phrases before single characters."""
    return f"SELECT doc_id, {d.sha(converted())} AS digest, length({converted()}) AS n_chars FROM {t.zh}"


def converted(text: str = "zh") -> str:
    phrased = f"replace(replace(replace({text}, '软件', '軟體'), '数据', '資料'), '质量', '品質')"
    return f"translate({phrased}, '{lx.SIMPLIFIED}', '{lx.TRADITIONAL}')"


def pre6(d: Spark, t: Names) -> str:
    """Lines by document: number of lines, longest line in UTF-16 units, bytes."""
    return f"SELECT doc_id, count(*) AS n_lines, max(length(item) + {d.count('item', '[\\x{10000}-\\x{10FFFF}]')}) AS longest, sum({d.bytes('item')}) AS n_bytes FROM {lines(d, t.zh)} GROUP BY doc_id"


def pre10(d: Spark, t: Names) -> str:
    """Register: formal by an anchor that no ideograph or letter precedes, or by 本合約 or 本契約 in the first 100 characters."""
    anchor = rf"(^|[^{HAN}A-Za-z0-9])(" + "|".join(lx.FORMAL) + ")"
    return f"SELECT doc_id, CASE WHEN {d.has('zh', anchor)} OR {d.has('substring(zh, 1, 100)', '本合約|本契約')} THEN 'formal' ELSE 'casual' END AS register FROM {t.zh}"


def pre12(d: Spark, t: Names) -> str:
    """Characters by class."""
    return f"SELECT doc_id, {d.count('zh', f'[{HAN}]')} AS han, {d.count('zh', '[A-Za-z]')} AS latin, {d.count('zh', '[0-9]')} AS digits, {d.count('zh', '[，。！？；：、]')} AS marks FROM {t.zh}"


def src7(d: Spark, t: Names) -> str:
    """Content type by the path's suffix."""
    path = "lower(url)"
    return f"SELECT page_id, CASE WHEN {path} LIKE '%.md' OR {path} LIKE '%.markdown' THEN 'markdown' WHEN {path} LIKE '%.yml' OR {path} LIKE '%.yaml' THEN 'yaml' WHEN {path} LIKE '%.json' THEN 'json' ELSE 'plain' END AS content_type FROM {t.pages}"


def exc13(d: Spark, t: Names) -> str:
    """String values and keys of a JSON text."""
    return f"SELECT event_id, {d.count('props', '\"[^\"]*\"[ ]*:')} AS keys, {d.json('props', '$.k')} AS k FROM {t.events}"


def exc16(d: Spark, t: Names) -> str:
    """Declared language of a page, and whether it is a Chinese one."""
    tag = d.first("html", 'lang="([^"]*)"', 1)
    return f"SELECT page_id, {tag} AS lang, lower({d.first(tag, '^[A-Za-z]+')}) IN ('zh', 'cmn', 'yue', 'wuu', 'nan', 'hak', 'gan', 'lzh') AS chinese FROM {t.pages}"


def exc10(d: Spark, t: Names) -> str:
    """YAML keys at the beginnings of lines."""
    return f"SELECT doc_id, {d.count('zh', '(?m)^[ \\t]*[A-Za-z_][A-Za-z0-9_-]*[ \\t]*:')} AS n FROM {t.zh}"


def exc5(d: Spark, t: Names) -> str:
    """Texts with URLs and mentions blanked out: what is left for the detectors."""
    clean = d.sub("zh", MASK, " ")
    return f"SELECT doc_id, length(zh) - length({clean}) AS masked_chars, {d.count(clean, '軟件')} AS visible, {d.count('zh', '軟件')} AS present FROM {t.zh}"


OPS: dict[str, Callable[[Spark, Names], str]] = {
    "lex1_matches": lex1, "lex2_spelling": lex2, "lex5_absorbers": lex5, "lex8_superstring_cover": lex8, "lex9_clue_gate": lex9, "lex16_casing": lex16, "lex17_rule_coverage": lex17, "pre4_script": pre4, "pre6_lines": pre6, "pre7_conversion": pre7, "pre10_register": pre10,
    "pre12_character_classes": pre12, "src7_content_type": src7, "exc5_blank_out": exc5, "exc10_yaml_keys": exc10, "exc13_json_keys": exc13, "exc16_language_tag": exc16,
}
