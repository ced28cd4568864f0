"""The score of translated style: five signals against thresholds that depend on the domain.

Signals are read from the text without its URLs and mentions; texts of fewer than
200 characters have no score.  The fifth signal is the number of findings of the
translated-style detectors by 1,000 characters; of two passes of one family
that overlap the indexed one counts.  Findings are counted before the join by document.
"""

from __future__ import annotations

from collections.abc import Callable

from ..dialect import Spark
from ..functions.matching import MASK, Masks, compiled
from ..plans.registered import Names
from ..plans.texts import called
from .segments import CUT
from .shapes import ANY, SHAPES, detected, findings, tr18, words

# Thresholds by domain (passive, weak verbs, pronouns and findings by 1,000 characters; 的 in a clause), and weights.
DOMAINS = (("general", 3.0, 2.0, 8.0, 5.0, 4), ("technical", 6.0, 4.0, 6.0, 7.0, 5), ("literary", 1.5, 1.0, 10.0, 3.0, 3), ("news", 2.5, 2.0, 7.0, 4.0, 4))
WEIGHTS = {"passive": 1.0, "weak": 0.8, "pronouns": 0.6, "found": 0.5, "chain": 0.7}
PREFIXES = "進行 加以 予以 展開 作出 給予 提供"
OBJECTS = "討論 分析 研究 調查 測試 開發 設計 評估 檢查 審查 修改 更新 比較 溝通 合作 訓練 處理 管理 規劃 改善 調整 整合 驗證 觀察 監控 維護 決定 回應 貢獻 改變 承諾 解釋 判斷 選擇 反應 讓步 保證 回答 犧牲 努力 支援 協助 檢討 投票 改革 發表 發展"
PRONOUNS = "他們|她們|他|她|它"
WEAK = f"{words(PREFIXES)}{ANY}{{0,2}}?{words(OBJECTS)}"
#: Detectors without a family of two passes.
SINGLE = tuple(n for n in SHAPES if n.startswith("tr") and n not in ("tr11_connectives", "tr12_nominal_chain"))


def found(d: Spark, t: Names) -> str:
    """(doc_id, found): findings of translated style by document."""
    if d.name == "spark":
        # All are read at once; of a detector of several shapes equal findings count once.
        several = "detector IN (" + ", ".join(f"'{n}'" for n in SINGLE if isinstance(SHAPES[n][0], tuple)) + ")"
        once = f"count(DISTINCT CASE WHEN {several} THEN struct(detector, start, found, coalesce(suggestion, '')) END)"
        counted = f"SELECT doc_id, {once} + sum(CASE WHEN {several} THEN 0 ELSE 1 END) AS n FROM {detected(t.zh, SINGLE)} GROUP BY doc_id"
        return f"(SELECT doc_id, sum(n) AS found FROM ({counted} UNION ALL SELECT doc_id, count(*) AS n FROM ({tr18(d, t)}) GROUP BY doc_id) GROUP BY doc_id)"
    each = [f"SELECT doc_id FROM ({findings(SHAPES[n], d, t.zh)})" for n in SINGLE] + [f"SELECT doc_id FROM ({tr18(d, t)})"]
    return f"(SELECT doc_id, count(*) AS found FROM ({' UNION ALL '.join(each)}) GROUP BY doc_id)"


def signals_of(text: str) -> tuple[int, int, int, int, int]:
    """(chars, passive, weak, pronouns, chain) of one text without its URLs and mentions."""
    parts, at, chars = [], 0, len(text)
    for a, b in Masks(text).all():
        parts.append(text[at:a])
        at, chars = b, chars - (b - a)
    body = "，".join([*parts, text[at:]])
    clauses = compiled(rf"[，,。！？；\n{CUT}]").split(body)
    return chars, body.count("被"), len(compiled(WEAK).findall(body)), len(compiled(PRONOUNS).findall(body)), max(c.count("的") for c in clauses)


def measured(d: Spark, t: Names) -> str:
    """(doc_id, chars, passive, weak, pronouns, found, chain) of texts of 200 characters or more."""
    if d.name == "spark":
        counts = f"(SELECT doc_id, m.* FROM (SELECT doc_id, {called('translated', 'zh')} AS m FROM {t.zh}) WHERE m.chars >= 200)"
        return f"(SELECT c.*, CAST(coalesce(f.found, 0) AS BIGINT) AS found FROM {counts} c LEFT JOIN {found(d, t)} f ON c.doc_id = f.doc_id)"
    clean = f"(SELECT doc_id, length({d.sub('zh', MASK, '')}) AS chars, {d.sub('zh', MASK, '，')} AS body FROM {t.zh})"
    clauses = d.split(d.sub("body", r"[，,。！？；\n]", CUT), CUT)
    counts = f"(SELECT doc_id, chars, {d.count('body', '被')} AS passive, {d.count('body', WEAK)} AS weak, {d.count('body', PRONOUNS)} AS pronouns, {d.largest(d.map(clauses, 'c', d.count('c', '的')))} AS chain FROM {clean} WHERE chars >= 200)"
    return f"(SELECT c.*, CAST(coalesce(f.found, 0) AS BIGINT) AS found FROM {counts} c LEFT JOIN {found(d, t)} f ON c.doc_id = f.doc_id)"


def domains(d: Spark, source: str, keep: str = "doc_id") -> str:
    """(keep, domain, score) of measured texts in each domain."""

    def part(value: str, threshold: float, weight: float, reached: str) -> str:
        return f"CASE WHEN {value} {reached} {threshold} THEN least(2.0, greatest(0.1, ({value} - {threshold}) / {threshold})) * {weight} ELSE 0.0 END"

    rows = []
    for name, passive, weak, pronouns, issues, chain in DOMAINS:
        rates = (("passive", passive), ("weak", weak), ("pronouns", pronouns), ("found", issues))
        parts = [part(f"({k} * 1000.0 / chars)", v, WEIGHTS[k], ">") for k, v in rates] + [part("(chain * 1.0)", float(chain), WEIGHTS["chain"], ">=")]
        rows.append((f"'{name}'", f"round(least(1.0, ({' + '.join(parts)}) / {round(sum(WEIGHTS.values()), 1)}), 6)"))
    return d.rows(source, keep, ("domain", "score"), rows)


def sc6(d: Spark, t: Names) -> str:
    """Signals and score of general prose."""
    keep = "doc_id, chars, passive, weak, pronouns, found, chain"
    return f"SELECT {keep}, score FROM {domains(d, measured(d, t), keep)} WHERE domain = 'general'"


def sc7(d: Spark, t: Names) -> str:
    """Score of each text in each domain."""
    return f"SELECT doc_id, domain, score FROM {domains(d, measured(d, t))}"


def sc9(d: Spark, t: Names) -> str:
    """Weak verbs with their objects, outside URLs and mentions."""
    return f"SELECT doc_id, n FROM (SELECT doc_id, {d.count(d.sub('zh', MASK, '，'), WEAK)} AS n FROM {t.zh}) WHERE n > 0"


OPS: dict[str, Callable[[Spark, Names], str]] = {"sc6_translation_score": sc6, "sc7_domain_thresholds": sc7, "sc9_weak_verbs": sc9}
