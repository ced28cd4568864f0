"""Policies, ambiguity tiers, fixes, reports and stores over the findings.

Rule, glossary, memory and judgment tables are joined by key; they are broadcast
only where the optimiser finds them below its size limit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from ..dialect import Spark
from ..functions import lexicon as lx
from ..functions.matching import hits
from ..plans.registered import Names
from ..plans.texts import called
from .lexical import MASK, PLACES, RULES, alternation, issues, matches, merged
from .segments import CUT, lines

MEMORY = lx.values(lx.MEMORY, "found, chosen", "m")
IGNORED = lx.values(lx.IGNORED, "found", "g")
PROPER = lx.values(lx.PROPER, "found", "p")
BANNED = lx.values(lx.BANNED, "term", "b")


def pol3(d: Spark, t: Names) -> str:
    """Findings left when the tags of two families are off."""
    return f"SELECT tags, count(*) AS n FROM {issues(d, t)} WHERE tags NOT IN ('optional', 'filler') GROUP BY tags"


def anti(d: Spark) -> str:
    return "LEFT ANTI JOIN" if d.name == "spark" else "ANTI JOIN"


def pol6(d: Spark, t: Names) -> str:
    """Glossary: findings on proper nouns go; a banned term makes the finding that covers it an error, and is an error of its own where none does."""
    proper = f"(SELECT i.* FROM {issues(d, t)} i {anti(d)} {PROPER} p ON i.found = p.found)"
    banned = f"(SELECT * FROM {d.hits(t.zh, 'zh', MASK + '|' + alternation(lx.BANNED))} WHERE item IN ({', '.join(chr(39) + b + chr(39) for b in lx.BANNED)}))"
    meets = "i.doc_id = b.doc_id AND i.start < b.start + length(b.item) AND b.start < i.start + length(i.found)"
    covered = f"SELECT i.doc_id, i.start, i.found, max(CASE WHEN b.item IS NULL THEN i.severity ELSE 3 END) AS severity FROM {proper} i LEFT JOIN {banned} b ON {meets} GROUP BY i.doc_id, i.start, i.found"
    bare = f"SELECT b.doc_id, b.start, b.item AS found, 3 AS severity FROM {banned} b {anti(d)} {proper} i ON {meets}"
    return f"SELECT doc_id, found, severity, count(*) AS n, min(start) AS first_place FROM ({covered} UNION ALL {bare}) GROUP BY doc_id, found, severity"


def pol7(d: Spark, t: Names) -> str:
    """Ignored terms become informational."""
    return f"SELECT CASE WHEN g.found IS NULL THEN i.severity ELSE 1 END AS severity, count(*) AS n FROM {issues(d, t)} i LEFT JOIN {IGNORED} g ON i.found = g.found GROUP BY 1"


def pol9(d: Spark, t: Names) -> str:
    """Translation memory: a term the user kept becomes informational."""
    return f"SELECT i.found, max(CASE WHEN m.chosen = i.found AND i.kind <> 'ai_filler' THEN 1 ELSE i.severity END) AS severity, sum(CASE WHEN m.chosen = i.found THEN 1 ELSE 0 END) AS changed FROM {issues(d, t)} i LEFT JOIN {MEMORY} m ON i.found = m.found GROUP BY i.found"


def pol10(d: Spark, t: Names) -> str:
    """Baseline: findings of the merged rules whose fingerprint (kind, form, document) a run with the base layer alone doesn't have."""
    key = d.sha("concat(kind, '|', found, '|', cast(doc_id AS string))")
    base = f"(SELECT source, max(kind) AS kind FROM {RULES} WHERE layer = 0 GROUP BY source)"
    before = f"(SELECT DISTINCT {key} AS print FROM (SELECT m.doc_id, m.item AS found, b.kind FROM {matches(d, t)} m JOIN {base} b ON m.item = b.source))"
    return f"SELECT a.doc_id, a.kind, a.found, count(*) AS n FROM (SELECT {key} AS print, doc_id, kind, found FROM {issues(d, t)}) a {anti(d)} {before} b ON a.print = b.print GROUP BY a.doc_id, a.kind, a.found"


def pol11(d: Spark, t: Names) -> str:
    """Stance: for a neutral reader findings of political colouring go; what is left, and what went, by kind."""
    return f"SELECT kind, sum(CASE WHEN kind <> 'political_coloring' THEN 1 ELSE 0 END) AS kept, sum(CASE WHEN kind = 'political_coloring' THEN 1 ELSE 0 END) AS dropped FROM {issues(d, t)} GROUP BY kind"


#: A heading's line: up to three spaces, one to six number signs, and a space.
HEADING = "(?m)^ {0,3}#{1,6}[ \\t][^\\n]*"


def within(d: Spark, t: Names, spans: str) -> str:
    """Findings (i) joined with the span (s) of their document that contains them."""
    return f"{issues(d, t)} i JOIN {spans} s ON i.doc_id = s.doc_id AND s.start <= i.start AND i.start + length(i.found) <= s.start + length(s.item)"


def pol12(d: Spark, t: Names) -> str:
    """Findings in headings get one step more severe."""
    return f"SELECT i.doc_id, i.start, i.found, least(3, i.severity + 1) AS severity FROM {within(d, t, d.hits(t.zh, 'zh', HEADING))}"


def pol13(d: Spark, t: Names) -> str:
    """Findings in cells between bars, with the cell's number in its line."""
    lined = f"(SELECT doc_id, ord AS line, item AS row_text FROM {lines(d, t.zh)} WHERE instr(item, '|') > 0)"
    cells = f"(SELECT doc_id, line, ord AS cell, item FROM {d.explode(f'(SELECT doc_id, line, {d.split(chr(114) + chr(111) + chr(119) + chr(95) + chr(116) + chr(101) + chr(120) + chr(116), chr(91) + chr(124) + chr(93))} AS cs FROM {lined})', 'cs', 'doc_id, line')})"
    forms = f"(SELECT doc_id, line, cell, item AS found FROM {d.explode(f'(SELECT doc_id, line, cell, {d.all(chr(105) + chr(116) + chr(101) + chr(109), PLACES)} AS fs FROM {cells})', 'fs', 'doc_id, line, cell')})"
    return f"SELECT f.doc_id, f.line, f.cell, f.found, count(*) AS n FROM {forms} f JOIN {merged()} r ON f.found = r.source GROUP BY f.doc_id, f.line, f.cell, f.found"


def pol15(d: Spark, t: Names) -> str:
    """Scan cache: texts already seen under another id, by content hash; only the first is scanned."""
    return f"SELECT digest, min(doc_id) AS first_doc, count(*) AS copies FROM (SELECT doc_id, {d.sha('text')} AS digest FROM {t.documents}) GROUP BY digest HAVING count(*) > 1"


def pol20(d: Spark, t: Names) -> str:
    """Evaluation: precision, recall, F1 and false positive rate of "has a finding" against the quality label, as an exercise of the metrics."""
    pairs = f"(SELECT l.doc_id, l.quality = 1 AS expected, i.doc_id IS NOT NULL AS found FROM {t.labels} l LEFT JOIN (SELECT DISTINCT doc_id FROM {issues(d, t)}) i ON l.doc_id = i.doc_id)"
    c = lambda cond: f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END)"
    return f"SELECT tp, fp, fn, round(tp * 1.0 / nullif(tp + fp, 0), 6) AS precision_rate, round(tp * 1.0 / nullif(tp + fn, 0), 6) AS recall_rate, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(fp * 1.0 / nullif(fp + tn, 0), 6) AS false_positive_rate FROM (SELECT {c('expected AND found')} AS tp, {c('NOT expected AND found')} AS fp, {c('expected AND NOT found')} AS fn, {c('NOT expected AND NOT found')} AS tn FROM {pairs})"


def sc16(d: Spark, t: Names) -> str:
    """Findings grouped by form, kind, suggestion and severity."""
    return f"SELECT found, kind, target, severity, count(*) AS n, min(doc_id) AS first_doc FROM {issues(d, t)} GROUP BY found, kind, target, severity"


def sc17(d: Spark, t: Names) -> str:
    """Counts by severity, with a total: one grouping set each."""
    return f"SELECT coalesce(cast(severity AS string), 'all') AS severity, count(*) AS n FROM {issues(d, t)} GROUP BY GROUPING SETS ((severity), ())"


def sc19(d: Spark, t: Names) -> str:
    """Places of each term in one string by document."""
    return f"SELECT doc_id, found, {d.joined('cast(start AS string)', 'start', ',')} AS places FROM {issues(d, t)} GROUP BY doc_id, found"


def sc20(d: Spark, t: Names) -> str:
    """Gate over the batch: more than 0 errors or 100 warnings fail."""
    return f"SELECT errors, warnings, errors > 0 OR warnings > 100 AS failed FROM (SELECT sum(CASE WHEN severity = 3 THEN 1 ELSE 0 END) AS errors, sum(CASE WHEN severity = 2 THEN 1 ELSE 0 END) AS warnings FROM {issues(d, t)})"


def sc21(d: Spark, t: Names) -> str:
    """Ratios by source; none where there is nothing to divide by."""
    return f"SELECT s.source, count(i.ord) AS n, round(count(i.ord) * 1.0 / nullif(count(DISTINCT s.doc_id), 0), 6) AS per_document FROM {t.documents} s LEFT JOIN {issues(d, t)} i ON s.doc_id = i.doc_id GROUP BY s.source"


def da1(d: Spark, t: Names) -> str:
    """Findings that are ambiguous: more than one suggestion, or clues."""
    return f"SELECT i.doc_id, i.found, count(*) AS n FROM {issues(d, t)} i JOIN {merged()} r ON i.found = r.source WHERE i.kind IN ('cross_strait', 'confusable') AND (instr(r.target, '/') > 0 OR r.clues <> '') GROUP BY i.doc_id, i.found"


def da2(d: Spark, t: Names) -> str:
    """Resolution by collocation in the sentence; without one the clue score decides."""
    pieces = d.explode(f"(SELECT doc_id, {d.split(d.sub('zh', '[。！？]', CUT), CUT)} AS ps FROM {t.zh})", "ps")
    table = lx.values(tuple((i, *c) for i, c in enumerate(lx.COLLOCATIONS)), "id, term, trigger_word, suggestion", "c")
    first = "min_by(suggestion, id)" if d.name == "spark" else "arg_min(suggestion, id)"
    return f"SELECT doc_id, term, suggestion, count(*) AS n FROM (SELECT p.doc_id, p.ord, c.term, {first} AS suggestion FROM {pieces} p JOIN {table} c ON instr(p.item, c.term) > 0 AND instr(p.item, c.trigger_word) > 0 GROUP BY p.doc_id, p.ord, c.term) GROUP BY doc_id, term, suggestion"


def da3(d: Spark, t: Names) -> str:
    """Clue score by document: min(0.3 + 0.4 * found / all clues, 0.7), 0 without any."""
    def score(source: str, clues: str) -> str:
        cs = clues.split("/")
        n = " + ".join(f"CASE WHEN instr(zh, '{c}') > 0 THEN 1 ELSE 0 END" for c in cs)
        return f"SELECT doc_id, '{source}' AS source, CASE WHEN {n} = 0 THEN 0 ELSE least(0.3 + 0.4 * ({n}) / {len(cs)}.0, 0.7) END AS score FROM {t.zh} WHERE instr(zh, '{source}') > 0"

    return "SELECT doc_id, source, round(score, 6) AS score FROM (" + " UNION ALL ".join(score(r[0], r[6]) for r in lx.RULES if r[6]) + ")"


def da10(d: Spark, t: Names) -> str:
    """Judgments by key: findings with a stored verdict that has not run out."""
    judged = lx.values((("進程", "keep", 10), ("文件", "change", 40), ("質量", "change", 5)), "found, verdict, age_days", "j")
    return f"SELECT i.found, j.verdict, count(*) AS n FROM {issues(d, t)} i JOIN {judged} j ON i.found = j.found WHERE j.age_days <= 30 GROUP BY i.found, j.verdict"


@lru_cache(maxsize=1)
def safe_fixes() -> dict[str, str]:
    """Forms of rules with one suggestion and no clues to weigh."""
    last: dict[str, tuple] = {}
    for r in lx.RULES:
        if r[0] not in last or r[5] >= last[r[0]][5]:
            last[r[0]] = r
    return {r[0]: r[1] for r in sorted(last.values()) if r[1] and "/" not in r[1] and r[1] != r[0] and not r[6]}


def fixed_text(text: str) -> str:
    """A text with every safe fix."""
    out, at = [], 0
    for a, b in hits(text, PLACES):
        to = safe_fixes().get(text[a:b])
        if to is not None:
            out += [text[at:a], to]
            at = b
    return "".join([*out, text[at:]])


def fixed(text: str, d: Spark) -> str:
    """Text with every safe fix spliced in at its finding: one suggestion, no clues to weigh; masks and exception forms stay as they are."""
    if d.name == "spark":
        return called("fixed", text)
    safe = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in safe_fixes().items())
    return d.spliced(text, PLACES, f"CASE x {safe} ELSE x END")


def fx1(d: Spark, t: Names) -> str:
    """Verdicts: one suggestion applies, several decline, none is skipped, a deletion applies."""
    return f"SELECT found, CASE WHEN target = '' AND kind = 'ai_filler' THEN 'delete' WHEN target = '' THEN 'skip' WHEN instr(target, '/') > 0 THEN 'decline' WHEN target = found THEN 'skip' ELSE 'apply' END AS verdict, count(*) AS n FROM {issues(d, t)} GROUP BY 1, 2"


def fx2(d: Spark, t: Names) -> str:
    """Fixed texts, by length and digest."""
    if d.name == "spark":
        return f"SELECT doc_id, length(fixed_text) AS n_chars, {d.sha('fixed_text')} AS digest FROM (SELECT doc_id, {fixed('zh', d)} AS fixed_text FROM {t.zh})"
    return f"SELECT doc_id, length({fixed('zh', d)}) AS n_chars, {d.sha(fixed('zh', d))} AS digest FROM {t.zh}"


def fx4(d: Spark, t: Names) -> str:
    """Where findings stand after the fixes before them: the running sum of length changes, by document."""
    moved = "sum(CASE WHEN target <> '' AND instr(target, '/') = 0 AND clues = '' THEN length(target) - length(found) ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"SELECT doc_id, start, start + coalesce({moved}, 0) AS place FROM {issues(d, t)}"


def fx5(d: Spark, t: Names) -> str:
    """Convergence: findings left after fixing."""
    again = f"(SELECT doc_id, {fixed('zh', d)} AS fixed_text FROM {t.zh})"
    return f"SELECT item AS found, count(*) AS n FROM {matches(d, t, 'fixed_text', again)} GROUP BY item"


def st6(d: Spark, t: Names) -> str:
    """Cache eviction: of the newest 2,000 entries those stay that fit 32 MiB; the running sum is over the 2,000 alone."""
    newest = f"(SELECT doc_id, {d.bytes('text')} AS held_bytes FROM {t.documents} WHERE text IS NOT NULL ORDER BY doc_id DESC LIMIT 2000)"
    return f"SELECT doc_id FROM (SELECT doc_id, sum(held_bytes) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM {newest}) WHERE held <= 33554432"


def st8(d: Spark, t: Names) -> str:
    """Badge: counts by severity of a document."""
    c = lambda s: f"sum(CASE WHEN severity = {s} THEN 1 ELSE 0 END)"
    return f"SELECT doc_id, {c(1)} AS info, {c(2)} AS warning, {c(3)} AS error, {c(2)} + {c(3)} AS badge FROM {issues(d, t)} GROUP BY doc_id"


def snk3(d: Spark, t: Names) -> str:
    """Compact report: the first place of each group and how many more."""
    return f"SELECT doc_id, found || ' ' || kind || CASE WHEN count(*) > 1 THEN ' (+' || cast(count(*) - 1 AS string) || ')' ELSE '' END AS line FROM {issues(d, t)} GROUP BY doc_id, found, kind"


def snk4(d: Spark, t: Names) -> str:
    """Tabular report: one line with tabs for each group."""
    return f"SELECT doc_id, CASE severity WHEN 3 THEN 'E' WHEN 2 THEN 'W' ELSE 'I' END || chr(9) || kind || chr(9) || found || chr(9) || target || chr(9) || cast(count(*) AS string) AS line FROM {issues(d, t)} GROUP BY doc_id, severity, kind, found, target"


OPS: dict[str, Callable[[Spark, Names], str]] = { "pol3_drop_tags": pol3, "pol6_glossary": pol6, "pol7_ignore_terms": pol7,
    "pol9_translation_memory": pol9, "pol10_baseline": pol10, "pol11_stance": pol11, "pol12_heading_boost": pol12, "pol13_table_cells": pol13, "pol15_scan_cache": pol15, "pol20_evaluation": pol20, "sc16_grouping": sc16, "sc17_summary": sc17, "sc19_places": sc19, "sc20_batch_gate": sc20, "sc21_ratios": sc21, "da1_eligible": da1,
    "da2_collocations": da2, "da3_clue_score": da3, "da10_judgments": da10, "fx1_verdicts": fx1, "fx2_fixed_text": fx2, "fx4_offset_shift": fx4, "fx5_convergence": fx5, "st6_cache_eviction": st6, "st8_badge": st8, "snk3_compact_report": snk3, "snk4_tabular_report": snk4,
}
