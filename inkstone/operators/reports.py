"""Sources, sinks, and the remaining policies and detectors over findings and segments."""

from __future__ import annotations

from collections.abc import Callable

from ..dialect import Spark
from ..functions import lexicon as lx
from ..functions.chars import HAN
from ..plans.registered import Names
from .documents import signals
from .lexical import MASK, MATCH, converted, issues, matches, merged
from .policies import fixed, within
from .segments import CUT, lines, paragraphs, sentences

H = f"[{HAN}]"
ENDED = "[^。！？；]"


def per_paragraph(pattern: str, least: int):
    def sql(d: Spark, t: Names) -> str:
        return f"SELECT doc_id, ord, {d.count('item', pattern)} AS n FROM {paragraphs(d, t.zh)} WHERE {d.count('item', pattern)} >= {least}"

    return sql


def src2(d: Spark, t: Names) -> str:
    """Pages whose path has one of the known suffixes, and the others."""
    return f"SELECT {d.has('lower(url)', '[.](md|markdown|yml|yaml|txt)$')} AS listed, count(*) AS n FROM {t.pages} GROUP BY 1"


def src3(d: Spark, t: Names) -> str:
    """Only documents on a list of changes: a semi join."""
    semi = "LEFT SEMI JOIN" if d.name == "spark" else "SEMI JOIN"
    return f"SELECT z.doc_id, length(z.zh) AS n_chars FROM {t.zh} z {semi} (SELECT doc_id FROM {t.labels} WHERE quality = 1) c ON z.doc_id = c.doc_id"


def src4(d: Spark, t: Names) -> str:
    """Texts within the size limit of 16 MiB, and their bytes."""
    return f"SELECT source, count(*) AS n, sum({d.bytes('text')}) AS n_bytes FROM {t.documents} WHERE {d.bytes('text')} <= 16777216 GROUP BY source"


def snk1(d: Spark, t: Names) -> str:
    """JSON report by document: counts by severity."""
    c = lambda s: f"cast(sum(CASE WHEN severity = {s} THEN 1 ELSE 0 END) AS string)"
    return "SELECT doc_id, '{\"errors\":' || " + c(3) + " || ',\"warnings\":' || " + c(2) + " || ',\"info\":' || " + c(1) + f" || '}}' AS report FROM {issues(d, t)} GROUP BY doc_id"


def snk2(d: Spark, t: Names) -> str:
    """Lines for people to read."""
    return f"SELECT doc_id, ord, concat(found, ' -> ', CASE WHEN target = '' THEN '(delete)' ELSE replace(target, '/', ' | ') END, ' [', kind, ']') AS line FROM {issues(d, t)}"


def snk5(d: Spark, t: Names) -> str:
    """The rules part of a SARIF log: each rule with a finding, its level and results."""
    return f"SELECT rule_id, max(CASE severity WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'note' END) AS level, count(*) AS results, count(DISTINCT doc_id) AS artifacts FROM {issues(d, t)} GROUP BY rule_id"


def snk7(d: Spark, t: Names) -> str:
    """Fixes as search and replace blocks: distinct pairs with how often they apply."""
    return f"SELECT found, target, count(*) AS n FROM {issues(d, t)} WHERE target <> '' AND instr(target, '/') = 0 AND target <> found GROUP BY found, target"


def pre8(d: Spark, t: Names) -> str:
    """Conversion of quoted values only: all of them, and nothing around them."""
    done = d.spliced("zh", "“[^”]*”", converted("x"))
    return f"SELECT doc_id, {d.count('zh', '“[^”]*”')} AS n, {d.sha(done)} AS digest FROM {t.zh} WHERE {d.has('zh', '“[^”]*”')}"


def pre9(d: Spark, t: Names) -> str:
    """Gate of the automatic conversion: more characters of the simplified script than of the traditional one."""
    s = "".join(a for a, b in zip(lx.SIMPLIFIED, lx.TRADITIONAL) if a != b)
    tr = "".join(b for a, b in zip(lx.SIMPLIFIED, lx.TRADITIONAL) if a != b)
    return f"SELECT doc_id, CASE WHEN {d.count('zh', f'[{s}]')} > {d.count('zh', f'[{tr}]')} THEN length({converted()}) ELSE -1 END AS converted_chars FROM {t.zh}"


def pre11(d: Spark, t: Names) -> str:
    """Register of the visible text: masked spans are blanked first."""
    clean = d.sub("zh", MASK, " ")
    anchor = rf"(^|[^{HAN}A-Za-z0-9])(" + "|".join(lx.FORMAL) + ")"
    return f"SELECT doc_id, {d.has(clean, anchor)} OR {d.has(f'substring({clean}, 1, 100)', '本合約|本契約')} AS formal FROM {t.zh}"


def pre13(d: Spark, t: Names) -> str:
    """Marks next to an ideograph, with up to three spaces between."""
    return f"SELECT doc_id, {d.count('zh', H + '[ ]{0,3}[,.!?;:]')} AS after_han, {d.count('zh', '[,.!?;:][ ]{0,3}' + H)} AS before_han FROM {t.zh}"


def exc4(d: Spark, t: Names) -> str:
    """Hits in masked spans and outside."""
    clean = d.sub("zh", MASK, CUT)
    return f"SELECT doc_id, {d.count('zh', MATCH)} AS all_hits, {d.count(clean, MATCH)} AS outside FROM {t.zh}"


def exc11(d: Spark, t: Names) -> str:
    """Front matter at the beginning."""
    return f"SELECT doc_id, substring(zh, 1, 3) = '---' AS front, {d.count('zh', '(?m)^---[ ]*$')} AS fences FROM {t.zh}"


def exc9(d: Spark, t: Names) -> str:
    """Table cells: lines with bars, by number of cells."""
    return f"SELECT doc_id, count(*) AS n, sum({d.count('item', '[|]')} - 1) AS cells FROM {lines(d, t.documents, 'text')} WHERE {d.count('item', '[|]')} >= 2 GROUP BY doc_id"


def exc14(d: Spark, t: Names) -> str:
    """Placeholders and escapes in JSON strings."""
    return f"SELECT event_id, {d.count('props', '[{][^{}]{1,64}[}]')} AS placeholders FROM {t.events}"


def exc17(d: Spark, t: Names) -> str:
    """Lines that comments switch off: their own line, or the next one."""
    mark = "(<!--|//|#)[ ]*zhtw:[ ]*disable"
    lined = f"(SELECT doc_id, item, coalesce(lag(item) OVER (PARTITION BY doc_id ORDER BY ord), '') AS before FROM {lines(d, t.zh)})"
    own, following = d.has("item", mark + "-line"), d.has("before", mark + "-next-line")
    return f"SELECT doc_id, count(*) AS n FROM {lined} WHERE {own} OR {following} GROUP BY doc_id"


def seg8(d: Spark, t: Names) -> str:
    """Words of more than one character that the dictionary has, by greedy longest match."""
    known = "(" + "|".join(sorted({w for r in lx.RULES for w in (r[0], *r[1].split("/")) if len(w) > 1}, key=lambda w: (-len(w), w))) + ")"
    return f"SELECT doc_id, {d.count('zh', known)} AS n, {d.distinct(d.all('zh', known, 1))} AS distinct_words FROM {t.zh}"


def lex3(d: Spark, t: Names) -> str:
    """Two rule sets by register: casual-only rules don't match in formal texts and shadow nothing there."""
    formal = d.has("zh", "|".join(lx.FORMAL))
    full, small = MATCH, "(" + "|".join(sorted({r[0] for r in lx.RULES if r[2] != "ai_filler"}, key=lambda f: (-len(f), f))) + ")"
    return f"SELECT doc_id, {formal} AS formal, CASE WHEN {formal} THEN {d.count('zh', small)} ELSE {d.count('zh', full)} END AS n FROM {t.zh}"


def lex11(d: Spark, t: Names) -> str:
    """Positional clues: 程序 with 運行 after it within 20 characters, and 用戶 with none of 界面 after it."""
    return f"SELECT doc_id, {d.count('zh', '程序' + ENDED + '{0,20}運行')} AS before_clue, {d.count('zh', '用戶')} - {d.count('zh', '用戶' + ENDED + '{0,20}界面')} AS not_before_clue FROM {t.zh}"


def lex12(d: Spark, t: Names) -> str:
    """Deletions that take a following comma with them."""
    return f"SELECT doc_id, {d.count('zh', '(大概|希望對你有幫助)[，：]')} AS extended, {d.count('zh', '大概|希望對你有幫助')} AS deletions FROM {t.zh}"


def lex13(d: Spark, t: Names) -> str:
    """Suggestion selected by the first clue group that the sentence holds."""
    pick = f"CASE WHEN {d.has('item', '計算機|運行|內存')} THEN '行程' WHEN {d.has('item', '歷史|談判')} THEN '進程' ELSE '行程/程序' END"
    return f"SELECT doc_id, {pick} AS suggestion, count(*) AS n FROM {sentences(d, t.zh)} WHERE instr(item, '進程') > 0 GROUP BY doc_id, {pick}"


def ai7(d: Spark, t: Names) -> str:
    """Attributions without a source: no year, bracket or named authority in the sentence."""
    return f"SELECT doc_id, count(*) AS n FROM {sentences(d, t.zh)} WHERE {d.has('item', '有研究指出|專家表示|眾所皆知|報告顯示')} AND NOT {d.has('item', '[0-9]{4}|[(（]|大學|研究院')} GROUP BY doc_id"


def ai28(d: Spark, t: Names) -> str:
    """Line metaphors: an abstract term, two anaphora or more and a verb of growth in one paragraph."""
    return f"SELECT doc_id, ord FROM {paragraphs(d, t.zh)} WHERE {d.has('item', '時代|科技|城市')} AND {d.count('item', '它|這')} >= 2 AND {d.has('item', '發展|成長|改變')}"


def ai39(d: Spark, t: Names) -> str:
    """Findings that are mentions, within corner brackets: by rule, and how many findings are left without them."""
    inner = d.hits(t.zh, "zh", "「[^「」]*」")
    spoken = f"(SELECT DISTINCT i.doc_id, i.start, i.found FROM {within(d, t, inner)})"
    return f"SELECT i.doc_id, i.found, count(m.start) AS mentions, count(*) - count(m.start) AS used FROM {issues(d, t)} i LEFT JOIN {spoken} m ON i.doc_id = m.doc_id AND i.start = m.start GROUP BY i.doc_id, i.found HAVING count(m.start) > 0"


def tr17(d: Spark, t: Names) -> str:
    """Long modifiers: spans without a comma, of 18 characters or more, with three 的."""
    clauses = d.explode(f"(SELECT doc_id, {d.split(d.sub('zh', '[，。！？；、]', CUT), CUT)} AS cs FROM {t.zh})", "cs")
    return f"SELECT doc_id, count(*) AS n, max(length(item)) AS longest FROM {clauses} WHERE length(item) >= 18 AND {d.count('item', '的')} >= 3 GROUP BY doc_id"


def sc2(d: Spark, t: Names) -> str:
    """Phrase signal: mean excess of the phrases that occur."""
    return f"SELECT doc_id, present, round(CASE WHEN present = 0 THEN 0 ELSE excess / present END, 6) AS signal FROM {signals(d, t)} WHERE chars >= 500"


def sc18(d: Spark, t: Names) -> str:
    """Resolution tier of each finding's rule."""
    return f"SELECT CASE WHEN instr(r.target, '/') > 0 AND r.clues <> '' THEN 'clues' WHEN instr(r.target, '/') > 0 THEN 'judge' ELSE 'rule' END AS tier, count(*) AS n FROM {issues(d, t)} i JOIN {merged()} r ON i.found = r.source GROUP BY 1"


def da4(d: Spark, t: Names) -> str:
    """Profile prior: preferred suggestions with their weights."""
    prior = lx.values((("進程", "行程", 0.4), ("文件", "檔案", 0.3), ("質量", "品質", 0.5)), "term, suggestion, weight", "p")
    return f"SELECT p.term, p.suggestion, p.weight, count(*) AS n FROM {issues(d, t)} i JOIN {prior} p ON i.found = p.term GROUP BY p.term, p.suggestion, p.weight"


def da11(d: Spark, t: Names) -> str:
    """Context keys: white space dropped, up to 40 characters on each side of the first hit, hashed."""
    bare = d.sub("zh", r"\s+", "")
    at = f"instr({bare}, '進程')"
    return f"SELECT doc_id, {d.sha(f'concat({chr(39)}v1:{chr(39)}, substring({bare}, greatest(1, {at} - 40), 82))')} AS context_key FROM {t.zh} WHERE {at} > 0"


def fx6(d: Spark, t: Names) -> str:
    """State carried over a re-scan: findings of a term before and after fixing."""
    again = f"(SELECT doc_id, {fixed('zh', d)} AS fixed_text FROM {t.zh})"
    before = f"(SELECT doc_id, found, count(*) AS n FROM {issues(d, t)} GROUP BY doc_id, found)"
    after = f"(SELECT doc_id, item AS found, count(*) AS n FROM {matches(d, t, 'fixed_text', again)} GROUP BY doc_id, item)"
    return f"SELECT b.doc_id, b.found, b.n AS before_fix, a.n AS after_fix FROM {before} b JOIN {after} a ON b.doc_id = a.doc_id AND b.found = a.found"


def pol8(d: Spark, t: Names) -> str:
    """Suppressed terms, for good."""
    anti = "LEFT ANTI JOIN" if d.name == "spark" else "ANTI JOIN"
    return f"SELECT i.found, count(*) AS n FROM {issues(d, t)} i {anti} {lx.values(('軟件', '默認'), 'found', 's')} s ON i.found = s.found GROUP BY i.found"


def pol16(d: Spark, t: Names) -> str:
    """Digest of a document's report, to leave out what didn't change."""
    return f"SELECT doc_id, {d.sha(d.joined('found', 'ord'))} AS digest FROM {issues(d, t)} GROUP BY doc_id"


def st9(d: Spark, t: Names) -> str:
    """Masks that a caller supplies: runs in languages other than Chinese."""
    tag = d.first("html", 'lang="([^"]*)"', 1)
    return f"SELECT {tag} AS lang, count(*) AS pages, sum(length(html)) AS chars FROM {t.pages} WHERE NOT {d.has(f'lower({tag})', '^(zh|cmn|yue)')} GROUP BY {tag}"


OPS: dict[str, Callable[[Spark, Names], str]] = {
    "src2_extension_filter": src2, "src3_changed_documents": src3, "src4_size_limit": src4, "snk1_json_report": snk1, "snk2_human_report": snk2, "snk5_sarif_rules": snk5, "snk7_search_replace": snk7,
    "pre8_conversion_of_values": pre8, "pre9_conversion_gate": pre9, "pre11_visible_register": pre11, "pre13_adjacent_marks": pre13, "exc4_masked_hits": exc4, "exc9_table_cells": exc9, "exc11_front_matter": exc11,
    "exc14_placeholders": exc14, "exc17_suppression": exc17, "seg8_word_count": seg8, "lex3_register_rule_sets": lex3, "lex11_positional_clues": lex11, "lex12_deletion_extension": lex12,
    "lex13_context_suggestion": lex13, "ai7_bare_attribution": ai7, "ai28_line_metaphor": ai28, "ai34_psych_verdict": per_paragraph("他很(好|忙|累)", 2),
    "ai38_fake_depth": per_paragraph("(說實話|由此可見|意味著)", 2), "ai39_mentions": ai39, "tr17_long_modifier": tr17,
    "sc2_phrase_signal": sc2, "sc18_resolution_tier": sc18, "da4_profile_prior": da4,
    "da11_context_key": da11, "fx6_carried_state": fx6, "pol8_suppressed_terms": pol8, "pol16_report_digest": pol16, "st9_supplied_masks": st9,
}
