"""Detectors of grammar, machine style and translated style as findings with places.

A detector is a shape: what is read at once (``scan``), and in it a context
before, the finding, and a context after.  Shapes look at the text behind a line
break, so that a context before always exists.  What is read begins where the last reading ended:
of two findings that share their context the first counts.  A finding in or over
a URL or mention is none; of a shape that reads whole sentences or clauses, one that holds a
URL or mention is left alone.  Suggestions are rewritings of the finding; null
where a person must decide.  Null and empty texts have no finding.

The patterns avoid lookaround, so both engines read them alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

from ..dialect import HELD, Spark
from ..functions.chars import CONTEXT, HAN, MASKED
from ..functions import lexicon as lx
from ..functions.matching import MASK, Led, Masks, compiled, merged
from ..plans.registered import Names
from ..plans.texts import called

#: What ends a sentence.
ENDED = r"。！？!?\n"
#: A character inside a sentence, and inside a clause.
S = f"[^{ENDED}]"
C = f"[^{ENDED}，,；;：:]"
ANY = r"[\s\S]"
SENTENCE = S + "+[。！？!?]?"
CLAUSE = r"[^。！？!?\n，,]+"
OPENING = r"[。！？!?\n][ \t]*"


def words(text: str) -> str:
    """An alternation of the words, as they are ordered."""
    return "(?:" + "|".join(text.split()) + ")"


# The words that the detectors look for.
A_NOT_A = "是不是 有沒有 能不能 會不會 要不要 好不好 對不對 行不行 可不可以 願不願意 想不想 知不知道 喜不喜歡 認不認識 做不做 吃不吃 去不去 來不來 看不看 走不走"
ADJECTIVES = "漂亮 高興 開心 難過 傷心 生氣 快樂 緊張 害怕 著急 無聊 好看 難看 厲害 聰明 笨 冷 熱 忙 累 餓 渴 胖 瘦 大 小 多 少 長 短 高 矮 好 壞 新 舊 快 慢 早 晚 遠 近 深 淺 重 輕 難 容易"
NOMINALISED = "討論 分析 研究 調查 測試 開發 設計 評估 檢查 審查 修改 更新 比較 溝通 合作 訓練 處理 管理 規劃 改善 調整 整合 驗證 觀察 監控 維護"
ACTIONS = "決定 回應 貢獻 改變 調整 承諾 解釋 判斷 選擇 反應 讓步 保證 回答 犧牲 努力"
TREATED = "討論 分析 研究 調查 測試 開發 設計 評估 檢查 審查 修改 更新 比較 處理 管理 規劃 改善 調整 整合 驗證 觀察 監控 維護 計算 編輯 翻譯 優化 部署 配置 重構"
MIXED_UP = "仔細的看 認真的聽 慢慢的走 靜靜的坐 快速的跑 努力的工作 安靜的離開 輕輕的放 默默的承受 悄悄的走"
ADVERBS = "慢慢 靜靜 認真 安靜 輕輕 默默 悄悄 漸漸 緩緩 偷偷"
PERSONS = "畫家 學者 作家 工程師 程式設計師 設計師 研究員 運動員 球員 演員 歌手 作者 記者 教授 醫師 醫生"
NOT_WHEN = "下時作初今年日前地局事中然面選權代"


DEFINES, FOLLOWS, EXPLAINS = "定義 是指 就是 亦即 所謂 稱為 指的是", "因此 所以 結果 導致 造成 如果 一旦 將會 可能", "換言之 換句話說 簡單來說 簡言之 具體來說"
IMPLIED = ((DEFINES, "表示"), (FOLLOWS, "代表"), (EXPLAINS, "也就是說"))
FALSE_FRIENDS = "實際上 字面上 基本上 絕對地 肯定地 明顯地 嚴肅地表示 誠實地說"
ABSTRACT = "實施 分析 講解 理解 認識 發現 提升 下降 改善 評估 探索 建構 推動 落實 形成 確立 發展 建立 促進 強化 深化 整合 統合 落地 規劃 執行"
PAUSES = r"，、；：。！？,;:.!?（）()「」『』【】〔〕《》〈〉—－…\"“”‘’\-"
#: ASCII marks whose runs are markup where they open a line.
MARKUP = "#:-~*_=+`>|"


class Shape(NamedTuple):
    kind: str
    severity: int
    core: str
    to: str | None = None
    before: str = ""
    after: str = ""
    #: What is read at once; none means context, finding and context.
    scan: str = ""
    #: No finding where this matches in what was read.
    unless: str = ""
    #: A further condition over ``item``, ``place`` (of the finding in it) and ``found``.
    where: str | Callable[[Spark], str] = ""
    #: Findings of formal letters and contracts where this matches are none.
    formal: str = ""
    #: What of the finding is rewritten; none means all.
    part: str = ""
    #: The suggestion as an expression over ``item`` and ``found``, in place of a rewriting.
    rewrite: str | Callable[[Spark], str] = ""
    #: ``where`` and ``rewrite`` where a text is read outside SQL: of (item, place, found) and (item, found).
    keeps: Callable[[str, int, str], bool] | None = None
    writes: Callable[[str, str], str | None] | None = None
    #: What an item must fulfil to hold a finding, tried before its pattern; and the characters a match begins with, where the pattern doesn't say.
    quick: Callable[[str], bool] | None = None
    lead: str = ""


def grammar(severity: int, core: str, to: str | None = None, **more: str) -> Shape:
    return Shape("grammar", severity, core, to, **more)


def ai(core: str, to: str | None = None, **more: str) -> Shape:
    return Shape("ai_style", 1, core, to, **more)


def translated(severity: int, core: str, to: str | None = None, **more: str) -> Shape:
    return Shape("translationese", severity, core, to, **more)


def inside(scan: str) -> dict[str, str]:
    """For a finding anywhere in what is read."""
    return {"scan": scan, "before": f"{ANY}*?", "after": f"{ANY}*"}


_WHEN = f"當(?:[^{NOT_WHEN}。！？!?\\n]{S}{{0,26}}?)?"
_SOURCE = rf"[ \t]*[^。！？!?\n，,；;：:\[\]\s][^。！？!?\n，,；;：:\[\]]*?"
#: A clause of two Latin words or more, one of them in lower case, keeps its mark.
_LATIN = "(^|[^A-Za-z])[a-z][A-Za-z]*[^A-Za-z]+[A-Za-z]|[A-Za-z][^A-Za-z]+[a-z]"
_WIDE = "translate(found, ',!?;:.', '，！？；：。')"
_WIDE_MARKS, _DIGITS = str.maketrans(",!?;:.", "，！？；：。"), str.maketrans("０１２３４５６７８９", "0123456789")
_widened = lambda item, found: found.translate(_WIDE_MARKS)
_TERM = words(FALSE_FRIENDS)
_SPAN = r"[^、。！？!?\n；.]"
_RUNS = lambda marks: "(?:" + "|".join(f"\\x{{{ord(c):02X}}}{{3,}}" for c in marks) + ")"
SYMBOLS = "".join(chr(i) for i in range(0x21, 0x7F) if not chr(i).isalnum())
_HEADS = f"的{words('實施 改善 提升 下降')}[^。！？!?\\n，,；;和與及、]*?的{words('提升 改善 下降')}|的{words('分析 講解 理解 認識')}[^。！？!?\\n，,；;和與及、]*?的{words('發現 理解 認識')}"

#: A detector is one shape or several, whose findings are united.
SHAPES: dict[str, Shape | tuple[Shape, ...]] = {
    "ort1_halfwidth_marks": (
        Shape("punctuation", 2, "[,?;]", before=f"[{CONTEXT}][ ]*", rewrite=_WIDE, writes=_widened),
        Shape("punctuation", 2, "[.!]", before=f"[{CONTEXT}][ ]*", after=f"{ANY}?", unless=r"\.[.A-Za-z0-9]\z|!\[\z", rewrite=_WIDE, writes=_widened),
        Shape("punctuation", 2, "[,!?;]", before=rf"[^A-Za-z0-9 ()/_\-{CONTEXT}][A-Za-z0-9 ()/_-]*", after=f"[ ]*[{CONTEXT}]", unless=_LATIN, rewrite=_WIDE, writes=_widened),
    ),
    "ort2_parentheses": Shape("punctuation", 2, r"\([^()\n]{1,512}\)", before=f"[{CONTEXT}]", after=f"[{CONTEXT}]", rewrite="concat('（', substring(found, 2, length(found) - 2), '）')", writes=lambda item, found: f"（{found[1:-1]}）"),
    "ort3_colon": (
        Shape("punctuation", 2, ":", before=f"[{CONTEXT}][ ]*", after=f"{ANY}?", unless=r":[0-9/]\z", rewrite=_WIDE, writes=_widened),
        Shape("punctuation", 2, ":", before=rf"[^A-Za-z0-9 ()/_\-{CONTEXT}\]][A-Za-z0-9()/_-][A-Za-z0-9 ()/_-]*", after=f"[ ]*[{CONTEXT}]", unless=_LATIN, rewrite=_WIDE, writes=_widened),
    ),
    "ort6_quote_pairs": Shape(
        "punctuation", 2, rf"“[^“”\n]*[{HAN}][^“”\n]*”", before=f"[A-Za-z] |{ANY}", after=f" [A-Za-z]|{ANY}?", unless=r"^[A-Za-z][\s\S]*[A-Za-z]\z",
        rewrite="concat('「', substring(found, 2, length(found) - 2), '」')", writes=lambda item, found: f"「{found[1:-1]}」",
    ),
    "ort10_ellipsis": (
        Shape("punctuation", 2, r"\.{3,}", "……", before=f"[{CONTEXT}]"),
        Shape("punctuation", 2, r"\.{3,}", "……", before=f"[^.={CONTEXT}]", after=f"[{CONTEXT}]"),
        Shape("punctuation", 2, "。{3,}", "……"),
        Shape("punctuation", 1, "…", "……", before=f"[{HAN}]", after=r"[^…]|\z"),
    ),
    "ort11_cjk_latin_spacing": (Shape("spacing", 1, "", before=f"[{HAN}]", after="[A-Za-z0-9]", rewrite="' '", writes=lambda item, found: " "), Shape("spacing", 1, "", before="[A-Za-z0-9]", after=f"[{HAN}]", rewrite="' '", writes=lambda item, found: " ")),
    "ort11_space_by_fullwidth_mark": (Shape("spacing", 1, "[ ]+", before="[，。！？；：]", rewrite="''", writes=lambda item, found: ""), Shape("spacing", 1, "[ ]+", before="[^ ，。！？；：]", after="[，。！？；：]", rewrite="''", writes=lambda item, found: "")),
    "ort11_fullwidth_digits": Shape("spacing", 1, r"[\x{FF10}-\x{FF19}]+", rewrite="translate(found, '０１２３４５６７８９', '0123456789')", writes=lambda item, found: found.translate(_DIGITS)),
    "ort5_enumeration_comma": Shape("punctuation", 1, f"[{HAN}]{{1,4}}，[{HAN}]{{1,4}}，[{HAN}]{{1,4}}", "、", after="[，。]", part="，"),
    "ort9_range_mark": Shape("punctuation", 1, "[~-]", "～", before=f"[0-9{HAN}]", after=f"[0-9{HAN}]", unless="^[0-9]~[0-9]|[0-9]-|-[0-9]"),
    "ort11_repeated_fullwidth_mark": Shape("spacing", 1, "，{2,}|！{2,}|？{2,}|；{2,}|：{2,}", r"\1", part=f"^({ANY}){ANY}*", lead="，！？；："),
    "ort14_spaced_acronym": Shape("spacing", 1, "[A-Z] [A-Z](?: [A-Z])+", "", before="[^A-Za-z]", after=r"[^A-Za-z]|\z", part=" "),
    "grm1_a_not_a_with_ma": grammar(2, f"({words(A_NOT_A)}){S}*嗎", r"\1", after=r"[ \t]*(?:[。！？!?\n]|\z)"),
    "grm2_he_joining_clauses": grammar(1, "和", "，", before="[了過著來去完好到]", after=f"[我你他她它這那]{ANY}{{0,9}}", unless="和.*(一樣|一般|相同|類似|相似)"),
    "grm3_bare_shi_adjective": grammar(
        1, f"({words('我們 你們 他們 她們 這個 那個 我 你 他 她 它 這 那')})是({words(ADJECTIVES)})", r"\1很\2", after=rf"[^{HAN}]|[的了啊呀呢吧嗎又且並但而]|\z"
    ),
    "grm4_redundant_preposition": grammar(1, f"(強調){ANY}{{0,2}}?在|(討論|研究|分析){ANY}{{0,2}}?關於|(影響|考慮|處理){ANY}{{0,2}}?到", r"\1\2\3", lead="強討研分影考處"),
    "grm5_nominalised_verb": grammar(1, f"(?:進行|加以|予以){ANY}{{0,2}}?({words(NOMINALISED)})", r"\1", formal="^予以"),
    "grm6_verbose_action": grammar(1, f"(?:做出|作出){ANY}{{0,1}}?({words(ACTIONS)})", r"\1"),
    "grm7_dui_jinxing": grammar(1, rf"對([^於。！？!?\n，,；;：:]{C}{{0,5}}?)進行{ANY}{{0,2}}?({words(TREATED)})", r"\2\1", before="[^針面絕相反比核校應配]"),
    "grm8_double_attribution": grammar(
        1, "根據(?:" + "|".join(f"({_SOURCE}){v}" for v in ("顯示", "指出", "表明", "表示", "說明")) + ")", r"根據\1\2\3\4\5", after=f"{ANY}?", unless=r"(說明[書文]|表示[式法]|顯示[器屏卡幕])\z"
    ),
    "ai1_implication": ai(
        "意味著", **inside(SENTENCE), rewrite=lambda d: "CASE " + " ".join(f"WHEN {d.has('item', words(w))} THEN '{to}'" for w, to in IMPLIED) + " END",
        writes=lambda item, found: next((to for w, to in IMPLIED if compiled(words(w)).search(item)), None),
    ),
    "ai17_tricolon": ai("|".join(f"{_SPAN}{{{n}}}、{_SPAN}{{{n}}}、{_SPAN}{{{n}}}" for n in range(1, 9)), before=r"[、。！？!?\n；.]", after=r"[、。！？!?\n；.]|\z"),
    "ai3_passive_rewrite": ai("被(廣泛(?:使用|採用|應用))", r"\1"),
    "ai4_didactic": ai(f"的{words('故事 案例 經驗 教訓 歷史')}{S}{{0,7}}?{words('告訴 提醒 啟示')}{words('我們 後人 世人')}"),
    "ai5_vague_exaggeration": ai(rf"{words('領先 超前 超越')}{S}{{0,18}}?{words('時代 業界 同期')}(?:{S}{{0,4}}?[^。！？!?\n0-9])?[0-9]{{1,2}}年"),
    "ai18_negative_parallel": ai(f"{words('不只是 不僅是 不僅僅是')}(?:{S}{{0,28}}?而是|{S}{{0,28}}?更是)"),
    "ai20_significance_stamp": ai(f"奠定{S}*?理論基礎|提供{S}*?重要框架|發揮{S}*?關鍵作用|印證{S}*?重要性"),
    "ai21_era_opener": ai(f"隨著{S}{{0,40}}?不斷發展"),
    "ai25_formulaic_despite": ai(f"儘管{S}{{0,40}}?挑戰{S}*?{words('仍然 持續 蓬勃發展 繼續')}{S}*[。！？!?]?"),
    "ai26_false_range": ai(f"從{S}*?到{S}*?再到", where="length(found) >= 10", keeps=lambda item, place, found: len(found) >= 10),
    "ai31_colon_reveal": ai(rf"[^，,。；！？!?\n：]{{0,10}}{words('在於 的是 答案是 就是 只有一個')}：不是[^：。！!\n]*?，而?是[^：。！!\n]*[。！!]", before=r"[，,。；！？\n]", unless="：[^：。！!]{25,}|：.*："),
    "ai35_fake_candor": ai("說實話", before=OPENING, after="[？?]"),
    "ai36_opening_announcement": ai("廢話不多說", before=OPENING),
    "tr2_abstract_subject": translated(1, f"{S}{{0,17}}?的{words('減少 增加 提高 下降 通過 實施')}{S}*?{words('導致 標誌著 意味著')}{S}*[。！？!?]?", scan=SENTENCE, quick=lambda item: "的" in item and ("導致" in item or "標誌著" in item or "意味著" in item)),
    "tr3_conditional_sentence": translated(1, words("如果 假如 若"), scan=SENTENCE, before=f"{ANY}*", after=f"{ANY}*", where="length(item) >= 6 AND place >= floor(length(item) / 2)", keeps=lambda item, place, found: len(item) >= 6 and place >= len(item) // 2),
    "tr5_copula_classifier": translated(1, "是一(?:個|名|位)", scan=SENTENCE, before=f"{ANY}*?", after=f"{ANY}*的{ANY}*"),
    "tr6_de_mixup": translated(2, words(MIXED_UP), "地", part="的"),
    "tr7_de_chain": translated(2, CLAUSE, scan=CLAUSE, where="length(found) - length(translate(found, '的', '')) >= 4", quick=lambda item: item.count("的") >= 4),
    "tr8_redundant_di": translated(1, f"({words(ADVERBS)})地", r"\1"),
    "tr9_tense_markers": translated(1, f"{S}*[0-9][年月日]{S}*[。！？!?]?", scan=SENTENCE, where="length(item) - length(translate(item, '曾已過了', '')) >= 3", quick=lambda item: sum(map(item.count, "曾已過了")) >= 3),
    "tr10_superlative_one_of": translated(1, r"(?:最|極為)[^之。！？!?\n]{1,18}之一", unless=f"{words(PERSONS)}之一"),
    "tr11_connectives": translated(1, f"因為{S}{{0,38}}?所以|雖然{S}{{0,38}}?但是|{_WHEN}的時候|如果{S}{{0,38}}?那麼", formal=".", lead="因雖當如"),
    "tr12_nominal_chain": translated(1, _HEADS),
    "tr13_false_friends": (
        translated(1, _TERM, scan=CLAUSE, before=f"{ANY}*?", after=f"{ANY}*{_TERM}{ANY}*"),
        translated(1, _TERM, scan=CLAUSE, before=f"{ANY}*{_TERM}{ANY}*?", after=f"{ANY}*"),
        translated(1, _TERM, after=r"[ ]*[(（][A-Za-z][A-Za-z ]*[)）]"),
    ),
    "tr16_head_chain": translated(1, f"{words(ABSTRACT)}(?:的{words(ABSTRACT)}){{2,}}{HELD}"),
    "rh1_long_sentence": translated(
        1, f"{ANY}{{8}}", scan=SENTENCE, before=r"\s*", after=f"{ANY}*", where=lambda d: f"{d.count('item', f'[{HAN}]')} > 30 AND {d.has('item', f'(?:[{HAN}][^{PAUSES}{HAN}]*){{15}}')}",
        quick=lambda item: len(item) > 30 and len(compiled(f"[{HAN}]").findall(item)) > 30 and compiled(f"(?:[{HAN}][^{PAUSES}{HAN}]*){{15}}").search(item) is not None,
    ),
    "tr15_paired_connectives": translated(1, f"因為({S}{{0,38}}?所以)|雖然({S}{{0,38}}?但是)|({_WHEN})的時候|(如果{S}{{0,38}}?)那麼", r"\1\2\3\4", formal=".", lead="因雖當如"),
}


#: What opens or closes a formal letter, where no ideograph or letter precedes.
FORMAL = rf"(^|[^{HAN}A-Za-z0-9])(" + "|".join(lx.FORMAL) + ")"


def formal(d: Spark) -> str:
    """Whether a text is a formal letter or contract."""
    return f"({d.has('zh', FORMAL)} OR {d.has('substring(zh, 1, 100)', '本合約|本契約')})"


def findings(s: Shape | tuple[Shape, ...], d: Spark, source: str, masked: bool = False) -> str:
    """(doc_id, start, found, suggestion, kind, severity) of a detector over a relation (doc_id, zh).

    ``masked``: zh has MASKED for what its content type leaves alone, and a finding over that is none.
    """
    if d.name == "spark":
        name = next(n for n, x in NAMED.items() if x is s)
        distinct = "DISTINCT " if isinstance(s[0], tuple) else ""
        return f"SELECT {distinct}doc_id, start, found, suggestion, kind, severity FROM {detected(source, [name], masked)}"
    return " UNION ".join(one(x, d, source, masked) for x in s) if isinstance(s[0], tuple) else one(s, d, source, masked)


def detected(source: str, names: list[str] | tuple[str, ...], masked: bool = False, keep: str = "doc_id") -> str:
    """(keep, detector, start, found, suggestion, kind, severity) of several detectors, whose texts are read once; Spark's."""
    each = f"(SELECT {keep}, {called('found', 'zh', chr(39) + ' '.join(names) + chr(39), str(masked).lower())} AS found_of FROM {source})"
    return f"(SELECT {keep}, f.* FROM (SELECT {keep}, explode_outer(found_of) AS f FROM {each}) WHERE f IS NOT NULL)"


def behind_masks(s: Shape) -> Shape:
    """The shape with sentences and clauses that end at a mask."""
    return s._replace(**{k: getattr(s, k).replace(ENDED, ENDED + MASKED) for k in ("core", "before", "after", "scan", "unless")})


class Reader:
    """A shape's reading of one text; ``one`` says the same in SQL."""

    def __init__(self, s: Shape, masked: bool) -> None:
        s = behind_masks(s) if masked else s
        self.shape, self.masked = s, masked
        self.read = compiled(s.scan or f"(?:{s.before})(?:{s.core})(?:{s.after})")
        self.read = Led(compiled(f"[{s.lead}]"), self.read) if s.lead else self.read
        self.full = compiled(rf"^({s.before})({s.core})(?:{s.after})\z")
        #: What a sentence must hold, where the finding may stand anywhere in it.
        self.needs = compiled(s.core) if s.scan and s.before.startswith(ANY) else None
        self.unless, self.formal = (compiled(x) if x else None for x in (s.unless, s.formal))
        self.part = compiled(s.part or rf"^(?:{s.core})\z")

    def findings(self, text: str, items: Iterator[tuple[int, str]]) -> Iterator[tuple]:
        s, quick, match = self.shape, self.shape.quick, self.full.match
        needs = self.needs.search if self.needs is not None else None
        for a, item in items:
            if quick is not None and not quick(item) or needs is not None and needs(item) is None:
                continue
            m = match(item)
            if m is None or ("://" in item or "@" in item) and compiled(MASK).search(item) or self.unless is not None and self.unless.search(item):
                continue
            if self.formal is not None and self.formal.search(item) and formal_text(text):
                continue
            place, found = m.end(1), m[2]
            if self.masked and MASKED in found or s.keeps is not None and not s.keeps(item, place, found):
                continue
            if s.writes is not None:
                to = s.writes(item, found)
            else:
                to = None if s.to is None else self.part.sub(s.to, found)
            yield a + place - 1, found, to, s.kind, s.severity


@lru_cache(maxsize=512)
def readers(name: str, masked: bool) -> list[Reader]:
    s = NAMED[name]
    return [Reader(x, masked) for x in (s if isinstance(s[0], tuple) else (s,))]


@lru_cache(maxsize=1)
def formal_text(text: str) -> bool:
    if not any(w in text for w in lx.FORMAL) and "本合約" not in text[:100] and "本契約" not in text[:100]:
        return False
    return compiled(FORMAL).search(text) is not None or compiled("本合約|本契約").search(text[:100]) is not None


def found_in(text: str, names: list[str], masked: bool = False) -> Iterator[tuple]:
    """(detector, start, found, suggestion, kind, severity) of detectors in one text; of a detector of several shapes each finding once."""
    body, scanned = "\n" + text, {}
    masks = Masks(body)

    def items(r: Reader) -> Iterator[tuple[int, str]]:
        if not r.shape.scan:
            return ((a, body[a:b]) for a, b, mask in merged(r.read, body, masks) if not mask)
        if r.needs is not None and r.needs.search(body) is None:
            return ()
        if r.read not in scanned:
            scanned[r.read] = [(m.start(), m[0]) for m in r.read.finditer(body)]
        return scanned[r.read]

    for name in names:
        each = readers(name, masked)
        if len(each) == 1:
            yield from ((name, *f) for f in each[0].findings(text, items(each[0])))
        else:
            yield from ((name, *f) for f in dict.fromkeys(f for r in each for f in r.findings(text, items(r))))


def one(s: Shape, d: Spark, source: str, masked: bool = False) -> str:
    s = behind_masks(s) if masked else s
    said = lambda x: x(d) if callable(x) else x
    keep = "doc_id, formal" if s.formal else "doc_id"
    register = f", {formal(d)} AS formal" if s.formal else ""
    body = f"(SELECT doc_id{register}, concat(chr(10), zh) AS body FROM {source})"
    context = f"(?:{s.before})(?:{s.core})(?:{s.after})"
    read = s.scan or f"{MASK}|{context}"
    full = rf"^({s.before})({s.core})(?:{s.after})\z"
    conditions = [d.has("item", full), f"NOT {d.has('item', MASK)}"] + ([f"NOT {d.has('item', s.unless)}"] if s.unless else [])
    conditions += [f"NOT (formal AND {d.has('item', s.formal)})"] if s.formal else []
    parts = f"(SELECT doc_id, start, item, CAST(length({d.first('item', full, 1)}) AS BIGINT) AS place, {d.first('item', full, 2)} AS found FROM {d.hits(body, 'body', read, keep)} WHERE {' AND '.join(conditions)})"
    parts = f"(SELECT * FROM {parts} WHERE instr(found, '{MASKED}') = 0)" if masked else parts
    rewritten = said(s.rewrite) or ("CAST(NULL AS string)" if s.to is None else d.sub("found", s.part or rf"^(?:{s.core})\z", s.to))
    where = f" WHERE {said(s.where)}" if s.where else ""
    return f"SELECT doc_id, start + place - 1 AS start, found, {rewritten} AS suggestion, '{s.kind}' AS kind, {s.severity} AS severity FROM {parts}{where}"


def shape_op(s: Shape | tuple[Shape, ...]) -> Callable[[Spark, Names], str]:
    return lambda d, t: findings(s, d, t.zh)


#: Runs of one symbol on the raw documents, but for markup that opens a line.
SYMBOL_RUNS = Shape("repetition", 1, _RUNS(SYMBOLS), scan=rf"\n[ \t\r]*{_RUNS(MARKUP)}|{_RUNS(SYMBOLS)}")


#: What SQL may ask for by name.
NAMED = SHAPES | {"pol19_symbol_runs": SYMBOL_RUNS}


def pol19(d: Spark, t: Names) -> str:
    """Runs of three or more of one symbol in the raw documents, with their places."""
    return findings(SYMBOL_RUNS, d, f"(SELECT doc_id, text AS zh FROM {t.documents})")


def tr18(d: Spark, t: Names) -> str:
    """Lexical findings that no finding of the indexed pass of their family overlaps."""
    anti = "LEFT ANTI JOIN" if d.name == "spark" else "ANTI JOIN"
    pairs = (("connective", "tr11_connectives", "tr15_paired_connectives"), ("nominalization", "tr12_nominal_chain", "tr16_head_chain"))
    if d.name == "spark":
        named = f"CASE detector {' '.join(f'WHEN {chr(39)}{p[k]}{chr(39)} THEN {chr(39)}{p[0]}{chr(39)}' for p in pairs for k in (1, 2))} END AS family"
        united = lambda k: f"SELECT doc_id, start, found, {named} FROM {detected(t.zh, [p[k] for p in pairs])}"
    else:
        united = lambda k: " UNION ALL ".join(f"SELECT doc_id, start, found, '{p[0]}' AS family FROM ({findings(SHAPES[p[k]], d, t.zh)})" for p in pairs)
    return f"SELECT a.doc_id, a.start, a.found, a.family FROM ({united(1)}) a {anti} ({united(2)}) b ON a.doc_id = b.doc_id AND a.family = b.family AND a.start < b.start + length(b.found) AND b.start < a.start + length(a.found)"


# Verbs that stand for 是 and 有, words around them that make others of them, and terms that make a text technical.
COPULAS = "作為 標誌著 充當 擁有 設有"
COPULA_COMPOUNDS = "所作為|大作為|擁有[權者感量]"
TECHNICAL = "系統 程式 函式 API 介面 模組 元件 架構 伺服器 資料庫"
#: Ideographs in 80 bytes.
NEAR = 26


def copulas(d: Spark, source: str) -> str:
    """Verbs in place of 是 and 有 with a technical term at most ``NEAR`` characters before or after; no suggestion."""
    is_term = "item IN (" + ", ".join(f"'{w}'" for w in TECHNICAL.split()) + ")"
    seen = d.hits(source, "zh", f"{MASK}|{COPULA_COMPOUNDS}|{words(COPULAS)}|{words(TECHNICAL)}")
    over = "OVER (PARTITION BY hit_row ORDER BY start ROWS BETWEEN"
    placed = f"""(SELECT doc_id, start, item, max(CASE WHEN {is_term} THEN start END) {over} UNBOUNDED PRECEDING AND CURRENT ROW) AS last_term,
      min(CASE WHEN {is_term} THEN start + length(item) END) {over} CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_end FROM {seen})"""
    near = f"(coalesce(last_term >= start - {NEAR}, false) OR coalesce(next_end <= start + length(item) + {NEAR}, false))"
    return f"SELECT doc_id, start, item AS found, CAST(NULL AS string) AS suggestion, 'ai_style' AS kind, 1 AS severity FROM {placed} WHERE item IN ({', '.join(chr(39) + w + chr(39) for w in COPULAS.split())}) AND {near}"


def ai2(d: Spark, t: Names) -> str:
    """Copula avoidance in technical surroundings."""
    return copulas(d, t.zh)


OPS: dict[str, Callable[[Spark, Names], str]] = {name: shape_op(s) for name, s in SHAPES.items()} | {"ai2_copula_avoidance": ai2, "pol19_symbol_runs": pol19, "tr18_phase_dedup": tr18}
