"""Segments, structural detectors over neighbouring segments, and document scores.

All windows are partitioned by document; segments come from one explode each, so
a query shuffles once, by doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from ..dialect import Spark
from ..functions import lexicon as lx
from ..functions.chars import HAN
from ..plans.registered import Names
from .lexical import issues
from ..functions.matching import compiled
from ..plans.texts import called
from .segments import CUT, lines, paragraphs, paragraphs_of, runs, sentences, sentences_of

H = f"[{HAN}]"


def seg1(d: Spark, t: Names) -> str:
    """Sentences: number, lengths."""
    return f"SELECT doc_id, count(*) AS n, sum(length(item)) AS chars, max(length(item)) AS longest FROM {sentences(d, t.zh)} GROUP BY doc_id"


def seg1_raw(d: Spark, t: Names) -> str:
    """Latin sentences of the raw documents."""
    return f"SELECT doc_id, count(*) AS n, max(length(item)) AS longest FROM {sentences(d, t.documents, 'text')} GROUP BY doc_id"


def seg2(d: Spark, t: Names) -> str:
    """Paragraphs."""
    return f"SELECT doc_id, count(*) AS n, max(length(item)) AS longest FROM {paragraphs(d, t.zh)} GROUP BY doc_id"


def by_paragraph(d: Spark, t: Names) -> str:
    """(doc_id, para, ord, item): the sentences of each paragraph."""
    return sentences(d, f"(SELECT doc_id, ord AS para, item FROM {paragraphs(d, t.zh)})", "item", "doc_id, para")


def seg3(d: Spark, t: Names) -> str:
    """Sentences of each paragraph."""
    return f"SELECT doc_id, para, count(*) AS n FROM {by_paragraph(d, t)} GROUP BY doc_id, para"


def line_runs(pattern: str, least: int):
    def sql(d: Spark, t: Names) -> str:
        return f"WITH s AS {lines(d, t.zh)} SELECT doc_id, first_ord, n FROM {runs('s', d.has('item', pattern), least)}"

    return sql


def orphan_lines(pattern: str, least: int):
    def sql(d: Spark, t: Names) -> str:
        return f"SELECT doc_id, count(*) AS n FROM {lines(d, t.zh)} WHERE {d.has('item', pattern)} GROUP BY doc_id HAVING count(*) >= {least}"

    return sql


def ai6(d: Spark, t: Names) -> str:
    """Phrase density: phrases beyond their rate per 1,000 characters in texts of 500 characters or more."""
    found = [(f"'{p}'", f"cast({th} AS double)", d.count("zh", p)) for p, th in lx.DENSITY]
    rows = d.rows(f"(SELECT doc_id, zh, length(zh) AS chars FROM {t.zh})", "doc_id, chars", ("phrase", "threshold", "n"), found)
    return f"SELECT doc_id, phrase, n, round(n * 1000.0 / chars, 6) AS per_1000 FROM {rows} WHERE chars >= 500 AND n * 1000.0 / chars > threshold"


def ai8(d: Spark, t: Names) -> str:
    """Binary contrasts: three or more and over 5 per 1,000 characters."""
    n = d.count("zh", "不是[^，。]{1,20}，(而)?是")
    return f"SELECT doc_id, n FROM (SELECT doc_id, {n} AS n, length(zh) AS chars FROM {t.zh}) WHERE chars >= 500 AND n >= 3 AND n * 1000.0 / chars > 5"


def ai9(d: Spark, t: Names) -> str:
    """Paragraph endings: of five paragraphs or more, three or more end in a formula."""
    return f"SELECT doc_id, n, formula FROM (SELECT doc_id, count(*) AS n, sum(CASE WHEN {d.has('item', '(很重要|的時代|有幫助|繼續前進)。[^。]*$')} THEN 1 ELSE 0 END) AS formula FROM {paragraphs(d, t.zh)} GROUP BY doc_id) WHERE n >= 5 AND formula >= 3"


def ai10(d: Spark, t: Names) -> str:
    """Dashes: three paragraphs or more with three or more of them each."""
    return f"SELECT doc_id, n FROM (SELECT doc_id, sum(CASE WHEN {d.count('item', '—')} >= 3 THEN 1 ELSE 0 END) AS n FROM {paragraphs(d, t.zh)} GROUP BY doc_id) WHERE n >= 3"


def ai12(d: Spark, t: Names) -> str:
    """Lists: over 0.4 of five paragraphs or more, and three or more, are lists."""
    return f"SELECT doc_id, n, lists FROM (SELECT doc_id, count(*) AS n, sum(CASE WHEN {d.has('item', '(?m)^[ ]*[-*+] ')} THEN 1 ELSE 0 END) AS lists FROM {paragraphs(d, t.zh)} GROUP BY doc_id) WHERE n >= 5 AND lists >= 3 AND lists > 0.4 * n"


def ai13(d: Spark, t: Names) -> str:
    """你 and 您 mixed: both counts, and which is the rarer."""
    return f"SELECT doc_id, plain, polite, CASE WHEN plain < polite THEN '你' ELSE '您' END AS rarer FROM (SELECT doc_id, {d.count('zh', '你')} - {d.count('zh', '迷你')} AS plain, {d.count('zh', '您')} AS polite FROM {t.zh}) WHERE plain > 0 AND polite > 0"


def ai15(d: Spark, t: Names) -> str:
    """Invisible characters."""
    return f"SELECT doc_id, n FROM (SELECT doc_id, {d.count('zh', '[\\x{200B}\\x{200C}\\x{2060}\\x{FEFF}]')} AS n FROM {t.zh}) WHERE n > 0"


def ai19(d: Spark, t: Names) -> str:
    """Closing phrases in the last sentence before a heading or the end."""
    return f"""SELECT doc_id, ord FROM (SELECT doc_id, ord, item, lead(item) OVER (PARTITION BY doc_id ORDER BY ord) AS following FROM {sentences(d, t.zh)})
      WHERE {d.has('item', '希望對你有幫助|總而言之|繼續前進')} AND (following IS NULL OR {d.has("coalesce(following, '')", '^#')})"""


def ai29(d: Spark, t: Names) -> str:
    """Slogans: one parallel sentence in two paragraphs or more."""
    return f"SELECT doc_id, item, count(DISTINCT para) AS n FROM {by_paragraph(d, t)} WHERE {d.has('item', '不是[^，]*，(而)?是')} GROUP BY doc_id, item HAVING count(DISTINCT para) > 1"


def neighbours(first: str, second: str):
    """A sentence and the one after it."""

    def sql(d: Spark, t: Names) -> str:
        return f"""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, item, lead(item) OVER (PARTITION BY doc_id ORDER BY ord) AS following FROM {sentences(d, t.zh)})
          WHERE {d.has('item', first)} AND {d.has("coalesce(following, '')", second)} GROUP BY doc_id"""

    return sql


def ai37(d: Spark, t: Names) -> str:
    """Stock conclusions: a paragraph's last sentence, of 20 characters at most, that begins with one."""
    last = f"SELECT *, max(ord) OVER (PARTITION BY doc_id, para) AS last, count(*) OVER (PARTITION BY doc_id, para) AS n FROM {by_paragraph(d, t)}"
    return f"SELECT doc_id, para FROM ({last}) WHERE ord = last AND n >= 2 AND length(item) <= 20 AND {d.has('item', '^(由此可見|總之|綜上所述)')}"


#: Patterns of a sentence and of the one behind it, as the operators below have them.
NEIGHBOURS = {"ai30_rhetorical_question": ("？$", "^(因為|答案|就是)"), "ai32_question_reveal": ("(到底|究竟)[^。]*？$", "^(因為|不是|就是)")}
_CLOSER, _SLOGAN, _STOCK = "希望對你有幫助|總而言之|繼續前進", "不是[^，]*，(而)?是", "^(由此可見|總之|綜上所述)"


def sentence_families_of(text: str) -> Iterator[tuple[str, int, int, int, str]]:
    """(family, para, last, n, item) of one text, of the operators over neighbouring sentences.

    A slogan is told by its paragraph and sentence, a stock conclusion by the number of its paragraph's
    sentences, the place of the last and, where that is one, the sentence; others by themselves.
    """
    closer, slogan, stock = compiled(_CLOSER), compiled(_SLOGAN), compiled(_STOCK)
    kept = [item for _, item in sentences_of(text)]
    following = [*kept[1:], None]
    for name, (first, second) in NEIGHBOURS.items():
        one, two = compiled(first.replace("$", r"\z")), compiled(second)
        if any(b is not None and one.search(a) and two.search(b) for a, b in zip(kept, following) if "？" in a):
            yield name, 0, 0, 0, ""
    if any((b is None or b.startswith("#")) and closer.search(a) for a, b in zip(kept, following)):
        yield "ai19_section_closers", 0, 0, 0, ""
    for para, body in paragraphs_of(text):
        within = list(sentences_of(body))
        for item in {item for _, item in within if "不是" in item and slogan.search(item)}:
            yield "ai29_repeated_slogan", para, 0, 0, item
        if within:
            last, item = within[-1]
            yield "ai37_stock_conclusion", para, last, len(within), item if len(item) <= 20 and stock.search(item) else ""


def sentence_families(d: Spark, t: Names) -> str:
    """(doc_id, name) of the operators over neighbouring sentences that find something; Spark's, in one reading."""
    rows = f"(SELECT doc_id, r.* FROM (SELECT doc_id, explode_outer(rows_found) AS r FROM (SELECT doc_id, {called('sentence_families', 'zh')} AS rows_found FROM {t.zh})) WHERE r IS NOT NULL)"
    # Rows with one id are one text to an operator: slogans of an id are counted together, and sentences of its paragraphs.
    stock = "name = 'ai37_stock_conclusion'"
    key = f"doc_id, name, CASE WHEN {stock} THEN CAST(para AS string) ELSE item END"
    grouped = f"(SELECT doc_id, name, count(DISTINCT para) AS paras, sum(n) AS n, max(struct(last, item)).item AS ending FROM {rows} GROUP BY {key})"
    return f"(SELECT doc_id, name FROM {grouped} WHERE CASE WHEN {stock} THEN n >= 2 AND ending <> '' WHEN name = 'ai29_repeated_slogan' THEN paras > 1 ELSE true END)"


def sc3(d: Spark, t: Names) -> str:
    """Punctuation profile: count, density and coefficient of variation of the gaps, for marks with nine gaps or more."""
    rows = d.rows(f"(SELECT doc_id, zh, length(zh) AS chars FROM {t.zh})", "doc_id, chars", ("mark", "parts"), [(f"'{m}'", d.split("zh", m)) for m in "，。；、"])
    key = f"(SELECT doc_id, mark, chars, {d.size('parts')} - 1 AS n, parts FROM {rows})"
    exploded = f"(SELECT doc_id, mark, chars, n, posexplode(parts) AS (ord, item) FROM {key})" if d.name == "spark" else f"(SELECT doc_id, mark, chars, n, unnest(range(len(parts))) AS ord, unnest(parts) AS item FROM {key})"
    return f"""SELECT doc_id, mark, max(n) AS n, round(max(n) * 1000.0 / max(chars), 6) AS per_1000, round(stddev_pop(length(item) + 1) / avg(length(item) + 1), 6) AS cv
      FROM {exploded} WHERE ord > 0 AND ord < n GROUP BY doc_id, mark HAVING count(*) >= 9"""


def sc5(d: Spark, t: Names) -> str:
    """Variability of sentence lengths, for ten sentences or more of four characters or more."""
    return f"SELECT doc_id, count(*) AS n, round(stddev_pop(length(item)), 6) AS deviation FROM {sentences(d, t.zh)} WHERE length(item) >= 4 GROUP BY doc_id HAVING count(*) >= 10"


def signals(d: Spark, t: Names) -> str:
    count = lambda p: d.count("zh", p)
    density = " + ".join(f"least(greatest(({count(p)} * 1000.0 / length(zh) - {th}) / {th}, 0), 2)" for p, th in lx.DENSITY)
    present = " + ".join(f"CASE WHEN {count(p)} > 0 THEN 1 ELSE 0 END" for p, _ in lx.DENSITY)
    return f"""(SELECT doc_id, length(zh) AS chars, {density} AS excess, {present} AS present,
      {count('[' + chr(0x200B) + chr(0x2060) + ']')} AS invisible, {count('被')} AS passive, {count('的')} AS de, {count(H)} AS han,
      {count('(進行|加以|予以|做出|作出)')} AS weak, {count('他們|她們|他|她|它')} AS pronouns, {count('——')} AS dashes, {count('不只是|不僅是')} AS parallels,
      {count('|'.join(sorted(lx.ORAL, key=len, reverse=True)))} AS oral FROM {t.zh})"""


def sc1(d: Spark, t: Names) -> str:
    """Machine-writing score of texts of 500 characters or more: phrases to 0.7, structure to 0.3, invisible characters to 0.2."""
    return f"""SELECT doc_id, round(least(1, 0.7 * least(1, CASE WHEN present = 0 THEN 0 ELSE excess / present END)
      + 0.1 * ((CASE WHEN dashes > 1 THEN 1 ELSE 0 END) + (CASE WHEN parallels > 0 THEN 1 ELSE 0 END)) + least(0.2, invisible / 3.0 * 0.2)), 6) AS score
      FROM {signals(d, t)} WHERE chars >= 500"""


def sc8(d: Spark, t: Names) -> str:
    """Most 的 in one clause."""
    clause = d.split(d.sub("zh", "[，。！？；\\n]", CUT), CUT)
    return f"SELECT doc_id, {d.largest(d.map(clause, 'c', d.count('c', '的')))} AS longest FROM {t.zh}"


def sc11(d: Spark, t: Names) -> str:
    """Spoken markers by ideographs, for 20 ideographs or more."""
    return f"SELECT doc_id, oral, han, round(oral * 1.0 / han, 6) AS density, oral * 1.0 / han > 0.05 AS flagged FROM {signals(d, t)} WHERE han >= 20"


def sc12(d: Spark, t: Names) -> str:
    """Quality flags of a text."""
    return f"SELECT doc_id, {d.has('zh', '(^|[^A-Za-z])[A-Z] [A-Z] [A-Z]($|[^A-Za-z])')} AS spaced_acronyms, {d.has('zh', '非常非常|研究研究|真的真的')} AS stutter, {d.has('zh', '嗯+|呃+')} AS asr_artifacts FROM {t.zh}"


def sc13(d: Spark, t: Names) -> str:
    """Regional axis: min(1, findings per 1,000 characters)."""
    return f"SELECT z.doc_id, round(least(1, count(i.ord) * 1000.0 / max(z.chars)), 6) AS regional FROM (SELECT doc_id, length(zh) AS chars FROM {t.zh}) z LEFT JOIN (SELECT doc_id, ord FROM {issues(d, t)} WHERE kind = 'cross_strait') i ON z.doc_id = i.doc_id WHERE z.chars > 0 GROUP BY z.doc_id"


def sc14(d: Spark, t: Names) -> str:
    """The five first findings by severity on each axis: a top-k report."""
    return f"SELECT doc_id, kind, ord, found FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY severity DESC, ord) AS k FROM {issues(d, t)}) WHERE k <= 5"


def sc15(d: Spark, t: Names) -> str:
    """Terms used in both forms: a flagged form and a standard one of the same rule."""
    forms = sorted({x for r in lx.RULES for x in r[1].split("/") if x}, key=lambda x: (-len(x), x))
    std = f"(SELECT doc_id, item, count(*) AS n FROM {d.explode(f'(SELECT doc_id, {d.all(chr(122) + chr(104), chr(40) + chr(124).join(forms) + chr(41), 1)} AS found FROM {t.zh})', 'found')} GROUP BY doc_id, item)"
    flagged = f"(SELECT doc_id, found, english, target, count(*) AS n FROM {issues(d, t)} WHERE target <> '' AND target <> found GROUP BY doc_id, found, english, target)"
    targets = d.explode(f"(SELECT doc_id, found, english, n, {d.split('target', '/')} AS ts FROM {flagged})", "ts", "doc_id, found, english, n")
    return f"SELECT f.doc_id, f.found, f.english, max(f.n) AS flagged, sum(s.n) AS standard FROM {targets} f JOIN {std} s ON f.doc_id = s.doc_id AND f.item = s.item GROUP BY f.doc_id, f.found, f.english"


def ort8(d: Spark, t: Names) -> str:
    """Brackets that don't close within their paragraph, and inner ones outside outer ones."""
    c = lambda m: d.count("item", m)
    return f"SELECT doc_id, ord, {c('「')} - {c('」')} AS outer_open, {c('『')} - {c('』')} AS inner_open, {c('『[^「」]*「')} AS swapped FROM {paragraphs(d, t.zh)} WHERE {c('「')} <> {c('」')} OR {c('『')} <> {c('』')} OR {c('『[^「」]*「')} > 0"


def ort13(d: Spark, t: Names) -> str:
    """Latin words of three letters or more twice in a row on the raw documents, with blanks or one line break between; each word is in one pair."""
    words = f"(SELECT doc_id, {d.all('text', r'[A-Za-z0-9]+[\p{L}\p{N}]*|\r\n|\r|\n|[^A-Za-z0-9 \t\r\n]+', 0)} AS ws FROM {t.documents})"
    over = "OVER (PARTITION BY doc_id ORDER BY ord)"
    near = f"SELECT doc_id, ord, lower(item) AS w, lower(lag(item) {over}) AS one, lower(lag(item, 2) {over}) AS two FROM {d.explode(words, 'ws')}"
    line_break = "one IN (chr(10), chr(13), concat(chr(13), chr(10)))"
    equal = f"SELECT doc_id, ord, w, coalesce(w = one OR ({line_break} AND w = two), false) AS again FROM ({near}) WHERE {d.has('w', '^[a-z0-9]{3,}$')}"
    runs = f"SELECT *, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM ({equal})"
    # A word that closed one pair opens none.
    places = f"SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY ord) AS place FROM ({runs})"
    return f"SELECT doc_id, count(*) AS n FROM ({places}) WHERE place % 2 = 0 GROUP BY doc_id"


def ort12(d: Spark, t: Names) -> str:
    """Doubled two-character units, from a list of units in both engines' reach."""
    units = ("非常", "研究", "真的", "可以", "我們")
    return f"SELECT doc_id, n FROM (SELECT doc_id, {d.count('zh', '|'.join(u + u for u in units))} AS n FROM {t.zh}) WHERE n > 0"


OPS: dict[str, Callable[[Spark, Names], str]] = {
    "seg1_sentences": seg1, "seg1_latin_sentences": seg1_raw, "seg2_paragraphs": seg2, "seg3_paragraph_sentences": seg3,
    "ai6_phrase_density": ai6, "ai8_binary_contrast": ai8, "ai9_paragraph_endings": ai9, "ai10_dash_overuse": ai10, "ai11_formulaic_headings": orphan_lines("^#+ .*(總結|展望|結論|前言)", 2),
    "ai12_list_density": ai12, "ai13_mixed_address": ai13, "ai14_stacked_please": line_runs(r"^[ ]*[-*+] *請", 3), "ai15_invisible_characters": ai15, "ai19_section_closers": ai19,
    "ai22_mechanical_bullets": line_runs(r"^[ ]*[-*+] [*][*][^*]+[*][*]", 3), "ai29_repeated_slogan": ai29, "ai30_rhetorical_question": neighbours("？$", "^(因為|答案|就是)"),
    "ai32_question_reveal": neighbours("(到底|究竟)[^。]*？$", "^(因為|不是|就是)"), "ai37_stock_conclusion": ai37,
    "sc1_machine_score": sc1, "sc3_punctuation_profile": sc3, "sc5_sentence_variability": sc5, "sc8_longest_de_chain": sc8, "sc11_oral_density": sc11,
    "sc12_quality_flags": sc12, "sc13_regional_axis": sc13, "sc14_top_findings": sc14, "sc15_consistency": sc15, "ort8_quote_hierarchy": ort8,
    "ort12_repetition_cjk": ort12, "ort13_repetition_latin": ort13, 
}
