"""Detectors over neighbouring sentences, paragraphs, lines and whole texts, as findings with places.

A text is cut once into units (sentences, headings, breaks) with running places; a
detector keeps the units it needs, counts by paragraph or by text, and says where the
first of them stands.  A text that holds nothing a detector looks for is left
before it is cut, so that only few texts are shuffled, each by a key of its row.

What is masked (URLs and mentions here; whatever ``structure.visible`` covers in
other content types) ends a sentence and is read by no detector.  ``n`` is what was
counted; ``found`` is empty where the finding is the text or a paragraph as a whole.
A sentence that begins inside brackets or quotation marks opened earlier in its
paragraph is ``quoted``, and detectors of what an author says leave it.

Edge cases: null and empty texts have no finding; equal and null ids are texts of
their own; of equal sentences the first counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from ..dialect import HELD, Spark
from ..functions.chars import MASKED
from ..functions.matching import MASK, compiled
from ..functions.matching import masked as masked_text
from ..plans.registered import Names
from ..plans.texts import called
from .shapes import words

#: What ends a sentence, and what closes behind it.
ENDED = "。！？!?"
BREAK = r"\r?\n\r?\n\s*"
HEADING = r"#{1,6}[ \t][^\r\n]*"
SENTENCE = rf"(?:[^{ENDED}\r\n{MASKED}]|\r?\n[^{ENDED}\r\n#{MASKED}])+{HELD}[{ENDED}]*[」』”）)\x{{22}}]*"
UNIT = f"{BREAK}|{HEADING}|{SENTENCE}"
PARAGRAPH = rf"[^\r\n](?:[^\r\n]|\r?\n[^\r\n])*{HELD}"
LINE = r"[^\n]*\n|[^\n]+"
BULLET = r"^[ \t]*(?:[-*+][ \t]|[0-9]+[.\x{29}](?:[ \t]|\z))"
LISTED = r"^[ \t]*(?:[-*] |[0-9]+[.\x{29}](?:[ \t]|\z))"

# Phrases by their density for 1,000 characters.
DENSITY = {
    "更重要的是": 0.5, "值得注意的是": 0.3, "這意味著": 0.5, "不容忽視": 0.2, "深刻影響": 0.3, "從某種意義上": 0.2, "從某種程度上": 0.2, "需要注意的是": 0.3, "在某種程度上": 0.2,
    "在這個過程中": 0.3,
}
# What the detectors look for.
CONCESSIVE, CONCEDED = "雖然 儘管 即便 即使", "但 卻 然而 不過"
PROGRESSIVE, PROGRESSED = "不僅 不只 不單", "更 還 也 亦"
PARAGRAPH_ENDINGS = "的基礎 的基石 的起點 的關鍵 的核心 證明了 揭示了 展示了 體現了 由此可見 這說明了 不難發現 這提示我們 這也印證了 這反映了 正是這 正是在 這也正是"
FORMULAIC_HEADINGS = "挑戰與未來展望 結論與展望 挑戰與機遇 問題與挑戰 優勢與劣勢 現狀與未來 回顧與展望 總結與展望 影響與意義 發展與演變"
CLOSERS = "展望未來 拭目以待 值得期待 我們有理由相信 具有重要意義 具有重要戰略意義 攜手共進 值得深思 任重道遠 值得持續觀察 值得持續關注 機會與風險並存 未來可期 前景可期"
LINES, GROWTH = "一條線 路線 軸線 脈絡 橋", "走出來 長出來 鋪出來 延伸 串起來 拓寬"
LEAD_INS = "那麼 那 但是 但 然而 可是 而 所以 究竟 到底 其實 主要 真正 說穿了 說白了"
FAQ = "faq 常見問題 q： q: 問： 問:"
VERDICTS = "你值得 你已經足夠 你已經很好 你並不孤單 你不需要證明 你從來都不是"
HARD_CUES, WEAK_CUES = "受試者 施測 迴歸分析 迴歸係數 相關係數 效果量", "本研究 樣本 取樣 顯著 假說"
DEPTH_FRAMES, DEPTH_LEADS = "歸根結底 歸根究底 說到底 真正的問題是", "但是 但 然而 可是 而 所以 那麼 其實"
PASSIVE_TERMS = "被定義為 被廣泛採用 被置於 被稱作 被觀察到 被記錄為"
#: Least 之一 for 200 characters, by domain.
ONE_OF = {"general": 2.0, "technical": 3.0, "literary": 1.0, "news": 2.5}
#: Shorter texts say nothing of densities.
LEAST_CHARS = 500

Op = Callable[[Spark, str], str]


def masked(d: Spark, source: str) -> str:
    """(doc_id, zh) with each character of URLs and mentions masked."""
    if d.name == "spark":
        return f"(SELECT doc_id, {called('masked', 'zh')} AS zh FROM {source})"
    return f"(SELECT doc_id, {d.spliced('zh', MASK, f'repeat({chr(39)}{MASKED}{chr(39)}, CAST(length(x) AS INT))')} AS zh FROM {source})"


def holding(d: Spark, source: str, pattern: str, more: str = "") -> str:
    """Texts in which ``pattern`` stands, with further columns."""
    return f"(SELECT doc_id, zh{more} FROM {source} WHERE {d.has('zh', pattern)})"


def flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def both(text: str, one: str, two: str) -> str:
    """Whether a text holds two words, in any order; read once each, where a pattern would read on from each place of the first."""
    return f"(instr({text}, '{one}') > 0 AND instr({text}, '{two}') > 0)"


def rows_of(name: str, source: str, keep: str, columns: str, *arguments: str) -> str:
    """(hit_row, keep, columns) of the rows that a function gives for each text; Spark's."""
    each = f"(SELECT hit_row, {keep}, {called(name, 'zh', *arguments)} AS rows_found FROM (SELECT *, monotonically_increasing_id() AS hit_row FROM {source}))"
    return f"(SELECT hit_row, {keep}, {', '.join(f'r.{c}' for c in columns.split(', '))} FROM (SELECT hit_row, {keep}, explode_outer(rows_found) AS r FROM {each}) WHERE r IS NOT NULL)"


def units(d: Spark, source: str, keep: str = "doc_id") -> str:
    """(hit_row, keep, para, ord, start, body): headings and sentences without the blanks before them."""
    if d.name == "spark":
        return rows_of("units", source, keep, "para, ord, start, body")
    counted = f"(SELECT *, sum({flag(d.has('item', '^' + BREAK))}) OVER (PARTITION BY hit_row ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS para FROM {d.hits(source, 'zh', UNIT, keep)})"
    bodies = f"(SELECT hit_row, {keep}, para, ord, start, length(item) AS held, {d.sub('item', '^' + chr(92) + 's+', '')} AS body FROM {counted})"
    return f"(SELECT hit_row, {keep}, para, ord, start + held - length(body) AS start, body FROM {bodies} WHERE body <> '')"


def said(d: Spark, source: str, keep: str = "doc_id") -> str:
    """Sentences with ``quoted``: whether they begin inside brackets or marks that their paragraph opened before."""
    if d.name == "spark":
        return rows_of("units", source, keep, "para, ord, start, body, quoted")
    net = f"{d.count('body', '[「『“（' + chr(92) + 'x{28}]')} - {d.count('body', '[」』”）' + chr(92) + 'x{29}]')}"
    over = "OVER (PARTITION BY hit_row, para ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND"
    sums = f"(SELECT *, coalesce(sum({net}) {over} 1 PRECEDING), 0) AS balance, coalesce(sum({d.count('body', chr(34))}) {over} 1 PRECEDING), 0) AS straight FROM {units(d, source, keep)})"
    depth = f"balance - least(0, min(balance) {over} CURRENT ROW))"
    return f"(SELECT hit_row, {keep}, para, ord, start, body, ({depth} > 0 OR straight % 2 = 1) AS quoted FROM {sums})"


#: UNIT as this engine reads it: what stands between line breaks at once.
_UNITS = UNIT.replace(rf"(?:[^{ENDED}\r\n{MASKED}]|", rf"(?:[^{ENDED}\r\n{MASKED}]+|")


def units_of(text: str) -> Iterator[tuple[int, int, int, str, bool]]:
    """(para, ord, start, body, quoted) of one text."""
    para, balance, least, straight = 0, 0, 0, 0
    breaks, blanks = compiled(BREAK), compiled(r"\s*")
    for i, m in enumerate(compiled(_UNITS).finditer(text)):
        item = m[0]
        if item[0] in "\r\n" and breaks.match(item):
            para, balance, least, straight = para + 1, 0, 0, 0
        body = item[blanks.match(item).end() :]
        if body:
            least = min(least, balance)
            yield para, i, m.end() - len(body), body, balance > least or straight % 2 == 1
            balance += sum(map(body.count, "「『“（(")) - sum(map(body.count, "」』”）)"))
            straight += body.count('"')


def pieces(d: Spark, source: str, pattern: str, keep: str = "doc_id") -> str:
    """(hit_row, keep, ord, start, item) of paragraphs or lines."""
    return f"(SELECT hit_row, {keep}, ord, start, item FROM {d.hits(source, 'zh', pattern, keep)})"


def out(rows: str, start: str, found: str, n: str, kind: str = "ai_style", severity: int = 1, family: str = "") -> str:
    named = family if family.startswith("CASE") else f"'{family}'"
    return f"SELECT doc_id, CAST({start} AS BIGINT) AS start, {found} AS found, CAST({n} AS BIGINT) AS n, '{kind}' AS kind, {severity} AS severity, {named} AS family FROM {rows}"


def first_of(d: Spark, rows: str, key: str, least: str, family: str) -> str:
    """The first hit by place of each group of ``rows`` (key, start, found) that has enough of them."""
    ranked = f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY start) AS k, count(*) OVER (PARTITION BY {key}) AS n FROM {rows})"
    return out(f"{ranked} WHERE k = 1 AND {least}", "start", "found", "n", family=family)


def phrase_density(d: Spark, source: str) -> str:
    """Phrases beyond their density in texts of 500 characters or more, at their first place."""
    long = holding(d, source, words(" ".join(DENSITY)), ", length(zh) AS chars")
    grouped = f"(SELECT doc_id, item, min(start) AS first, count(*) AS n, max(chars) AS chars FROM {d.hits(f'(SELECT * FROM {long} WHERE chars >= {LEAST_CHARS})', 'zh', words(' '.join(DENSITY)), 'doc_id, chars')} GROUP BY hit_row, doc_id, item)"
    least = "CASE item " + " ".join(f"WHEN '{p}' THEN {x}" for p, x in DENSITY.items()) + " END"
    return out(f"{grouped} WHERE n * 1000.0 / chars > {least}", "first", "item", "n", severity=2)


def binary_contrast(d: Spark, source: str) -> str:
    """Concessive and progressive turns within sentences: three or more and over 5 for 1,000 characters."""

    def turn(starts: str, turns: str) -> str:
        # The first word of the list that the sentence holds decides, with a turn behind it or not.
        each = " ".join(f"WHEN instr(body, '{w}') > 0 THEN {flag(d.has(f"substring(body, CAST(instr(body, '{w}') AS INT))", words(turns)))} * instr(body, '{w}')" for w in starts.split())
        return f"CASE {each} ELSE 0 END"

    long = f"(SELECT * FROM {holding(d, source, words(CONCESSIVE + ' ' + PROGRESSIVE), ', length(zh) AS chars')} WHERE chars >= {LEAST_CHARS})"
    cut = d.hits(long, "zh", r"[^。！？；;!?\n]+", "doc_id, chars")
    turned = f"(SELECT * FROM (SELECT hit_row, doc_id, chars, start, {turn(CONCESSIVE, CONCEDED)} AS a, {turn(PROGRESSIVE, PROGRESSED)} AS b FROM (SELECT *, item AS body FROM {cut})) WHERE a > 0 OR b > 0)"
    grouped = f"(SELECT doc_id, min(start + CASE WHEN a > 0 THEN a ELSE b END - 1) AS first, sum({flag('a > 0')} + {flag('b > 0')}) AS n, max(chars) AS chars FROM {turned} GROUP BY hit_row, doc_id)"
    return out(f"{grouped} WHERE n >= 3 AND n * 1000.0 / chars > 5.0", "first", "''", "n", family="binary_contrast")


def some_paragraphs(d: Spark, source: str, needs: str, hit: str, least: str, family: str) -> str:
    """Texts of which enough paragraphs (``n`` of ``total``) have ``hit``; the place is that of the first."""
    paras = f"(SELECT * FROM {pieces(d, holding(d, source, needs), PARAGRAPH)} WHERE {d.has('item', f'[^{chr(92)}s{MASKED}]')})"
    grouped = f"(SELECT doc_id, count(*) AS total, sum({flag(hit)}) AS n, min(CASE WHEN {hit} THEN start END) AS first FROM {paras} GROUP BY hit_row, doc_id)"
    return out(f"{grouped} WHERE {least}", "first", "''", "n", family=family)


#: The last 30 characters of a paragraph.
_TAIL = "substring(trim(item), greatest(1, CAST(length(trim(item)) AS INT) - 29), 30)"


def paragraph_endings(d: Spark, source: str) -> str:
    """Of five paragraphs or more, three or more end in a formula."""
    return some_paragraphs(d, source, words(PARAGRAPH_ENDINGS), d.has(_TAIL, words(PARAGRAPH_ENDINGS)), "total >= 5 AND n >= 3", "paragraph_endings")


def dash_overuse(d: Spark, source: str) -> str:
    """Three paragraphs or more with three dashes or more each."""
    return some_paragraphs(d, source, "—", f"{d.count('item', '—')} >= 3", "total >= 3 AND n >= 3", "dash_overuse")


def list_density(d: Spark, source: str) -> str:
    """Over 0.4 of five paragraphs or more, and three or more, hold a list."""
    listed = r"(?m)^[ \t]*(?:[-*] [ \t]*[^\s]|[0-9][^\n]{0,2}?\. [^\n]*[^\s])"
    return some_paragraphs(d, source, listed, d.has("item", listed), "total >= 5 AND n >= 3 AND n > 0.4 * total", "list_density")


def formulaic_headings(d: Spark, source: str) -> str:
    """Two headings or more by formula."""
    lines = f"(SELECT * FROM {pieces(d, holding(d, source, words(FORMULAIC_HEADINGS)), LINE)} WHERE {d.has('item', rf'^[ \t]*#')} AND {d.has('item', words(FORMULAIC_HEADINGS))})"
    return out(f"(SELECT doc_id, min(start) AS first, count(*) AS n FROM {lines} GROUP BY hit_row, doc_id HAVING count(*) >= 2)", "first", "''", "n", family="formulaic_headings")


def stacked_please(d: Spark, source: str) -> str:
    """Three steps or more in a row that begin with 請; indented lines between go on, other lines and empty ones end the run."""
    marker = BULLET + r"[ \t]*"
    opens = d.has("item", marker + "請")
    step = f"CASE WHEN {opens} THEN 'opens' WHEN {d.has('item', r'^[ \t]+[^\s]')} AND NOT {d.has('item', BULLET)} THEN 'goes on' ELSE 'ends' END"
    kept = f"(SELECT *, row_number() OVER (PARTITION BY hit_row ORDER BY ord) AS place FROM (SELECT hit_row, doc_id, ord, start + length({d.first('item', marker)}) AS start, {step} AS step FROM {pieces(d, holding(d, source, '請'), LINE)}) WHERE step <> 'goes on')"
    islands = f"(SELECT doc_id, hit_row, start, place - row_number() OVER (PARTITION BY hit_row ORDER BY ord) AS island FROM {kept} WHERE step = 'opens')"
    return out(f"(SELECT doc_id, min(start) AS first, count(*) AS n FROM {islands} GROUP BY hit_row, doc_id, island HAVING count(*) >= 3)", "first", "'請'", "n", family="stacked_please")


def mechanical_bullets(d: Spark, source: str) -> str:
    """Lists of three items or more that all open in bold, or all with a bold label of four characters and a colon."""
    lines = f"(SELECT hit_row, doc_id, ord, item, start + length({d.first('item', '^[ ' + chr(92) + 't]*')}) AS start FROM {pieces(d, holding(d, source, '[*][*]'), LINE)} WHERE {d.has('item', LISTED)})"
    bold, label = d.has("item", LISTED + r"[ \t]*[*][*]"), d.has("item", LISTED + r"[ \t]*[*][*][^*\n]{4}[*][*]\s*[：:]")
    mark = f"substring({d.sub('item', '^[ ' + chr(92) + 't]+', '')}, 1, 1)"
    islands = f"(SELECT *, ord - row_number() OVER (PARTITION BY hit_row ORDER BY ord) AS island, {mark} AS mark, {flag(bold)} AS bold, {flag(label)} AS label FROM {lines})"
    grouped = f"(SELECT doc_id, min(start) AS first, min_by(mark, ord) AS mark, count(*) AS n, sum(label) AS labels FROM {islands} GROUP BY hit_row, doc_id, island HAVING count(*) >= 3 AND count(*) = sum(bold))"
    return out(grouped, "first", "mark", "n", family="CASE WHEN labels = n THEN 'four_char_labels' ELSE 'mechanical_bullets' END")


def excessive_bold(d: Spark, source: str) -> str:
    """Two to four runs of bold in a sentence; in a paragraph of 30 characters or more three for 200 characters."""
    bold = lambda x: f"CAST(floor({d.count(x, '[*][*]')} / 2) AS BIGINT)"
    rich = holding(d, source, "[*][*]")
    sentences = f"(SELECT *, {bold('body')} AS n FROM {units(d, rich)})"
    paras = f"(SELECT *, {bold('item')} AS n, length(item) AS chars FROM {pieces(d, rich, PARAGRAPH)})"
    return out(f"{sentences} WHERE n BETWEEN 2 AND 4", "start", "substring(body, 1, 2)", "n", family="bold_in_sentence") + " UNION ALL " + out(
        f"{paras} WHERE chars >= 30 AND n >= 3 AND n >= ceil(chars / 200.0 * 3) AND substring(item, 1, 1) <> '{MASKED}'", "start", "substring(item, 1, 2)", "n", family="bold_in_paragraph"
    )


def em_dash_overuse(d: Spark, source: str) -> str:
    """Two double dashes or more in a paragraph."""
    paras = f"(SELECT *, {d.count('item', '——')} AS n FROM {pieces(d, holding(d, source, '——'), PARAGRAPH)})"
    return out(f"{paras} WHERE n >= 2", "start + instr(item, '——') - 1", "'——'", "n", family="em_dash_overuse")


def line_metaphor(d: Spark, source: str) -> str:
    """An abstract term of lines, two references to it or more, and a verb of growth in one paragraph."""
    c = lambda w: d.count("item", w)
    n = f"{c('這條線')} + {c('這條路線')} + greatest(0, {c('這條路')} - {c('這條路線')})"
    paras = f"(SELECT *, {n} AS n, {d.first('item', words(LINES))} AS term FROM {pieces(d, holding(d, source, words(GROWTH)), PARAGRAPH)} WHERE {d.has('item', words(GROWTH))} AND {d.has('item', words(LINES))})"
    return out(f"{paras} WHERE n >= 2", "start + instr(item, term) - 1", "term", "n", family="line_metaphor")


def repeated_slogan(d: Spark, source: str) -> str:
    """A parallel sentence of 8 to 80 characters in two paragraphs or more, at its first place."""
    if d.name == "spark":
        # A text is a group of its own, so it is counted where it is read.
        return out(rows_of("slogans", source, "doc_id", "first, body, n"), "first", "substring(body, 1, 8)", "n", family="repeated_slogan")
    bare = f"(SELECT *, trim({d.sub('body', f'[{ENDED}]+[」』”）)]*{chr(92)}s*{chr(92)}z', '')}) AS bare FROM {units(d, source)})"
    halves = [f"CAST(length({d.first('bare', h, g)}) AS INT)" for h in (r"^([^；]*)；([\s\S]*)",) for g in (1, 2)] + [f"CAST(length({d.first('bare', r'^([^，,]*)[，,]([\s\S]*)', g)}) AS INT)" for g in (1, 2)]
    halved = f"(SELECT *, CASE WHEN instr(bare, '；') > 0 THEN {halves[0]} ELSE {halves[2]} END AS one, CASE WHEN instr(bare, '；') > 0 THEN {halves[1]} ELSE {halves[3]} END AS two FROM {bare})"
    framed = f"({both('bare', '不是', '而是')} OR {both('bare', '不只', '更是')} OR {both('bare', '不只', '也是')} OR {d.count('bare', '越')} >= 2)"
    slogans = f"(SELECT * FROM {halved} WHERE length(bare) BETWEEN 8 AND 80 AND ({framed} OR (one >= 3 AND two >= 3 AND abs(one - two) <= 8)))"
    grouped = f"(SELECT doc_id, body, min(start) AS first, count(DISTINCT para) AS n FROM {slogans} GROUP BY hit_row, doc_id, body HAVING count(DISTINCT para) > 1)"
    return out(grouped, "first", "substring(body, 1, 8)", "n", family="repeated_slogan")


def slogans_of(text: str) -> Iterator[tuple[int, str, int]]:
    """(first, body, n) of the parallel sentences of one text that stand in several paragraphs."""
    end, spaces = compiled(rf"[{ENDED}]+[」』”）)]*\s*\z"), compiled("^[ ]+|[ ]+\\z")
    frames = (("不是", "而是"), ("不只", "更是"), ("不只", "也是"))
    places: dict[str, tuple[int, set[int]]] = {}
    for para, _, start, body, _ in units_of(text):
        places.setdefault(body, (start, set()))[1].add(para)
    for body, (first, paras) in places.items():
        if len(paras) < 2:
            continue
        bare = spaces.sub("", end.sub("", body)) if len(body) >= 8 else ""
        if not 8 <= len(bare) <= 80:
            continue
        framed = any(a in bare and b in bare for a, b in frames) or bare.count("越") >= 2
        if not framed:
            one, two = _halves(bare)
            framed = one >= 3 and two >= 3 and abs(one - two) <= 8
        if framed:
            yield first, body, len(paras)


def _halves(bare: str) -> tuple[int, int]:
    """Lengths on both sides of the first semicolon, or else of the first comma; none without one."""
    i = bare.find("；")
    if i < 0:
        i = next((k for k, c in enumerate(bare) if c in "，,"), -1)
    return (i, len(bare) - i - 1) if i >= 0 else (0, 0)


def _pairs(d: Spark, source: str, keep: str = "doc_id", needs: str = "") -> str:
    """Sentences with the one behind them in their paragraph, both without their lead-ins, and whether the paragraph lists questions; Spark's only those that hold ``needs``."""
    if d.name == "spark":
        return rows_of("pairs", source, keep, "para, ord, start, body, quoted, faq, question, answer", f"'{needs}'")
    led = rf"^(?:{words(LEAD_INS)}[，,、 ]*)+"
    over = "OVER (PARTITION BY hit_row, para ORDER BY ord)"
    listed = f"max({flag(d.has('lower(body)', words(FAQ)))}) OVER (PARTITION BY hit_row, para)"
    paired = f"(SELECT *, lead(body) {over} AS following, {listed} AS faq FROM {said(d, source, keep)})"
    return f"(SELECT *, {d.sub('body', led, '')} AS question, {d.sub('following', led, '')} AS answer FROM {paired} WHERE following IS NOT NULL)"


def pairs_of(text: str, needs: str) -> Iterator[tuple[int, int, int, str, bool, int, str, str]]:
    """(para, ord, start, body, quoted, faq, question, answer) of one text."""
    led, asked, faqs = compiled(rf"^(?:{words(LEAD_INS)}[，,、 ]*)+"), compiled(needs), FAQ.split()
    kept = list(units_of(text))
    listing = {para for para, _, _, body, _ in kept if any(w in body.lower() for w in faqs)}
    for (para, i, start, body, quoted), (after, _, _, following, _) in zip(kept, kept[1:]):
        if para == after and asked.search(body):
            yield para, i, start, body, quoted, int(para in listing), led.sub("", body), led.sub("", following)


def rhetorical_questions(d: Spark, source: str) -> str:
    """Two questions or more of a paragraph that answer themselves, one of them to say that the reader is wrong."""
    dramatic = f"({d.has('question', '^(?:你以為|大家都以為)[^。]*嗎')} AND {d.has('answer', '^錯(?:了|，)')})"
    plain = f"(({d.has('question', '^為什麼')} AND {d.has('answer', '^(?:是?因為|原因)')}) OR ({d.has('question', '^問題出在哪')} AND {d.has('answer', '^出在')}))"
    hits = f"(SELECT *, {flag(dramatic)} AS strong FROM {_pairs(d, holding(d, source, '你以為|大家都以為'), needs='你以為|大家都以為|為什麼|問題出在哪')} WHERE faq = 0 AND ({dramatic} OR {plain}))"
    ranked = f"(SELECT *, row_number() OVER (PARTITION BY hit_row, para ORDER BY ord) AS k, count(*) OVER (PARTITION BY hit_row, para) AS n, max(strong) OVER (PARTITION BY hit_row, para) AS staged FROM {hits})"
    return out(f"{ranked} WHERE k = 1 AND n >= 2 AND staged = 1", "start", "body", "n", family="rhetorical_questions")


def question_reveal(d: Spark, source: str) -> str:
    """A question of why with the answer at once, staged by 到底 or 究竟 or answered by a contrast; the first of a paragraph."""
    asked = f"{d.has('question', r'^為什麼[\s\S]*[？?]\z')} AND {d.has('answer', '^是?因為')}"
    staged = f"({both('answer', '不是', '而是')} OR {d.has('substring(body, 1, CAST(length(body) - length(question) AS INT))', '到底|究竟')})"
    return first_of(d, f"(SELECT hit_row, para, doc_id, start, body AS found FROM {_pairs(d, holding(d, source, '為什麼'), needs='為什麼')} WHERE NOT quoted AND faq = 0 AND {asked} AND {staged})", "hit_row, para", "n >= 1", "question_reveal")


def _within(d: Spark, source: str, needs: str, core: str, before: str, after: str, where: str = "") -> str:
    """(hit_row, para, doc_id, start, found) of a core within sentences that aren't quoted, at most one a sentence."""
    full = f"^({before})({core}){after}"
    hits = f"(SELECT * FROM {said(d, holding(d, source, needs))} WHERE NOT quoted{where})"
    return f"(SELECT hit_row, para, doc_id, start + length({d.first('body', full, 1)}) AS start, {d.first('body', full, 2)} AS found FROM {hits} WHERE {d.has('body', full)})"


def golden_contrast(d: Spark, source: str) -> str:
    """Three short contrasts or more of 不是 and 而是 in a paragraph."""
    core = "不是[^。！？；]{0,14}?[，,]而是[^，,。！？；]{0,14}"
    rows = _within(d, source, "[，,]而是", core, r"(?:[\s\S]*?[^是])?", r"(?:[，,。！？；]|\z)", " AND length(body) <= 40")
    return first_of(d, rows, "hit_row, para", "n >= 3", "golden_contrast")


def psych_verdict(d: Spark, source: str) -> str:
    """Two sentences or more of a paragraph that judge what goes on in the reader."""
    core = rf"你不是[\s\S]{{0,12}}?[，,]你(?:只是|其實)[^。！？；]*|{words(VERDICTS)}"
    return first_of(d, _within(d, source, f"你不是|{words(VERDICTS)}", core, r"[\s\S]*?", ""), "hit_row, para", "n >= 2", "psych_verdict")


def fake_depth(d: Spark, source: str) -> str:
    """Two different frames or more of a last word in a paragraph."""
    rows = _within(d, source, words(DEPTH_FRAMES), words(DEPTH_FRAMES), f"(?:{words(DEPTH_LEADS)}[，,]*)?", "")
    several = f"(SELECT *, min(found) OVER (PARTITION BY hit_row, para) AS least, max(found) OVER (PARTITION BY hit_row, para) AS most FROM {rows})"
    return first_of(d, f"(SELECT * FROM {several} WHERE least <> most)", "hit_row, para", "n >= 2", "fake_depth")


def stock_conclusion(d: Spark, source: str) -> str:
    """由此可見 at the head of a paragraph's last sentence of at most 20 characters; not in reports of studies, nor where the text's paragraphs end in formulas."""
    paras = d.filter(d.split("zh", r"\r?\n\r?\n"), "p", d.has("p", rf"[^\s{MASKED}]"))
    ended = d.filter(paras, "p", d.has("substring(trim(p), greatest(1, CAST(length(trim(p)) AS INT) - 29), 30)", words(PARAGRAPH_ENDINGS)))
    formula = f", ({d.size(paras)} >= 5 AND {d.size(ended)} >= 3) AS formula"
    units_of = f"(SELECT *, max(ord) OVER (PARTITION BY hit_row, para) AS last FROM {said(d, holding(d, source, '由此可見', formula), 'doc_id, formula')} WHERE NOT formula)"
    cue = lambda w: f"max(CASE WHEN ord < last AND instr(body, '{w}') > 0 THEN 1 ELSE 0 END)"
    hard, weak = (" + ".join(map(cue, w.split())) for w in (HARD_CUES, WEAK_CUES))
    at_end = f"ord = last AND NOT quoted AND {d.has('body', '^由此可見')} AND length(body) <= 20"
    grouped = f"(SELECT doc_id, count(*) AS n, min(CASE WHEN {at_end} THEN start END) AS first, {hard} AS hard, {weak} AS weak FROM {units_of} GROUP BY hit_row, doc_id, para)"
    return out(f"{grouped} WHERE n >= 2 AND first IS NOT NULL AND NOT (hard >= 1 AND hard + weak >= 3)", "first", "'由此可見'", "1", family="stock_conclusion")


def section_closers(d: Spark, source: str) -> str:
    """Closing formulas in the last sentence before a heading or the end, each at its first place."""
    heading = d.has("coalesce(following, '')", "^" + HEADING)
    body = f"(SELECT *, lead(body) OVER (PARTITION BY hit_row ORDER BY ord) AS following FROM {units(d, holding(d, source, words(CLOSERS)))})"
    closing = f"(SELECT * FROM {body} WHERE NOT {d.has('body', '^' + HEADING)} AND {d.has('body', words(CLOSERS))} AND (following IS NULL OR {heading}))"
    each = d.rows(closing, "doc_id, start", ("found", "place"), [(f"'{w}'", f"instr(body, '{w}')") for w in CLOSERS.split()])
    return out(f"{each} WHERE place > 0", "start + place - 1", "found", "1", family="section_closers")


def passive_density(d: Spark, source: str) -> str:
    """More passive marks in a paragraph of 20 characters or more than 2 for 100 characters, and than 2; set terms don't count."""
    paras = f"(SELECT *, {d.count('item', '被')} - {d.count('item', words(PASSIVE_TERMS))} AS n, length(item) AS chars FROM {pieces(d, holding(d, source, '被[^被]*被[^被]*被'), PARAGRAPH)})"
    return out(f"{paras} WHERE chars >= 20 AND n > greatest(2, ceil(chars / 100.0 * 2))", "start", "substring(item, 1, 2)", "n", "translationese", 2)


def one_of_density(d: Spark, source: str, domain: str = "general") -> str:
    """Two 之一 or more in a paragraph of 100 characters or more, at least as many for 200 characters as the domain allows."""
    paras = f"(SELECT *, {d.count('item', '之一')} AS n, length(item) AS chars FROM {pieces(d, holding(d, source, '之一'), PARAGRAPH)})"
    return out(f"{paras} WHERE chars >= 100 AND n >= 2 AND n * 200.0 / chars >= {ONE_OF[domain]}", "start + instr(item, '之一') - 1", "'之一'", "n", "translationese")


DETECTORS: dict[str, Op] = {
    "ai6_density_places": phrase_density, "ai8_contrast_places": binary_contrast, "ai9_ending_places": paragraph_endings, "ai10_dash_places": dash_overuse, "ai11_heading_places": formulaic_headings,
    "ai12_list_places": list_density, "ai14_please_places": stacked_please, "ai19_closer_places": section_closers, "ai22_bullet_places": mechanical_bullets, "ai23_bold_places": excessive_bold,
    "ai24_em_dash_places": em_dash_overuse, "ai28_metaphor_places": line_metaphor, "ai29_slogan_places": repeated_slogan, "ai30_rhetorical_places": rhetorical_questions,
    "ai32_reveal_places": question_reveal, "ai33_golden_places": golden_contrast, "ai34_verdict_places": psych_verdict, "ai37_conclusion_places": stock_conclusion,
    "ai38_depth_places": fake_depth, "tr1_passive_places": passive_density, "tr14_one_of_places": one_of_density,
}

#: Phrases of the view and what stands for them here, so that each detector meets its words; from top to bottom.
RESTATED = (
    ("廢話不多說，", "更重要的是，這不容忽視。到底為什麼？因為不是錢，而是人。"),
    ("紅色、藍色、綠色、", "歸根結底，這很難。但說到底，沒人懂。"),
    ("是一個好的地方。", "你值得更好。你不是累，你只是忙。"),
    ("發揮了關鍵作用。", "這是合作的基礎。\n\n"),
    ("蘋果，香蕉，橘子，", "雖然慢，但穩。不僅快，還好。即使晚，卻對。"),
    ("城市~鄉村", "這條線是一條線，這條線延伸"),
    ("希望對你有幫助。", "未來可期。"),
    ("他去了。他來了。", "你以為這樣好嗎？錯了。為什麼難？因為貴。"),
    ("總結與展望：", "總結與展望\n\n# 問題與挑戰"),
    ("核心：", "**核**和**心**，"),
    ("標誌著新的時代。", "是大城之一，也是名城之一。"),
)


def restated(d: Spark, t: Names) -> str:
    text = "zh"
    for old, new in RESTATED:
        text = f"replace({text}, '{old}', '{new}')"
    return f"(SELECT doc_id, {text} AS zh FROM {t.zh})"


def restated_text(text: str) -> str:
    """A text restated, and its URLs and mentions masked."""
    for old, new in RESTATED:
        text = text.replace(old, new)
    return masked_text(text)


def op(detector: Op) -> Callable[[Spark, Names], str]:
    def sql(d: Spark, t: Names) -> str:
        if d.name == "spark":
            return detector(d, f"(SELECT doc_id, {called('restated', 'zh')} AS zh FROM {t.zh})")
        return detector(d, masked(d, restated(d, t)))

    sql.__doc__ = detector.__doc__
    return sql


OPS: dict[str, Callable[[Spark, Names], str]] = {name: op(detector) for name, detector in DETECTORS.items()}
