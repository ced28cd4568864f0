"""Detectors that are a pattern over a text, a sentence, a paragraph or a line.

``TEXT`` patterns count in the whole text (those with places are in ``shapes``), runs are of sentences.
Patterns avoid lookaround, so both engines read them alike; an operator whose
rule needs more is in a module of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from ..dialect import Spark
from ..functions.chars import HAN, URL
from ..plans.registered import Names
from .segments import paragraphs, runs, sentences

H = f"[{HAN}]"

TEXT: dict[str, str] = {
    # exclusion spans
    "exc1_url_spans": URL,
    "exc1_mention_spans": r"@[a-zA-Z0-9_]+",
    "exc1_term_mention": "「[^「」]{1,12}」(一詞|這個詞|是的?(說法|用語))",
    "exc8_headings": r"(?m)^ {0,3}#{1,6}[ \t][^\n]*",
    # scores
    "sc10_longest_match_pronoun": "他們|她們|它們|我們|你們|他|她|它",
}

def text_op(pattern: str) -> Callable[[Spark, Names], str]:
    def sql(d: Spark, t: Names) -> str:
        return f"SELECT doc_id, n FROM (SELECT doc_id, {d.count('zh', pattern)} AS n FROM {t.zh}) WHERE n > 0"

    return sql


def run_op(flag: str, least: int) -> Callable[[Spark, Names], str]:
    """Runs of neighbouring sentences of one paragraph."""

    def sql(d: Spark, t: Names) -> str:
        inner = f"(SELECT doc_id, ord AS para, item FROM {paragraphs(d, t.zh)})"
        s = sentences(d, inner, "item", "doc_id, para")
        return f"WITH s AS {s} SELECT doc_id, para, first_ord, n FROM {runs('s', d.has('item', flag), least, 'doc_id, para')}"

    return sql


def paragraph_op(conditions: Callable[[Spark], str], value: Callable[[Spark], str]) -> Callable[[Spark, Names], str]:
    def sql(d: Spark, t: Names) -> str:
        return f"SELECT doc_id, ord, {value(d)} AS n FROM {paragraphs(d, t.zh)} WHERE {conditions(d)}"

    return sql


RUNS = {
    "tr4_pronoun_run": (r"^(他|她|它|他們|她們)", 3),
    "rh3_staccato": f"^{H}{{2,6}}[。！？]$",
}

OPS: dict[str, Callable[[Spark, Names], str]] = {k: text_op(p) for k, p in TEXT.items()}
OPS |= {k: run_op(*(v if isinstance(v, tuple) else (v, 3))) for k, v in RUNS.items()}

# Particles that end a sentence, and what may stand behind them.
ENDINGS = "的了呢"
CLOSERS = r"[\s。！？；，、….!?;,」』）)】〕》〉\x{22}\x{201D}\x{2019}]*"


def rh2(d: Spark, t: Names) -> str:
    """Three neighbouring sentences of one paragraph or more that end in the same particle; a run goes on as far as it can."""
    s = sentences(d, f"(SELECT doc_id, ord AS para, item FROM {paragraphs(d, t.zh)})", "item", "doc_id, para")
    ended = f"(SELECT doc_id, para, ord, {d.first('item', f'([{ENDINGS}]){CLOSERS}$', 1)} AS particle FROM {s})"
    island = f"SELECT *, ord - row_number() OVER (PARTITION BY doc_id, para, particle ORDER BY ord) AS island FROM {ended} WHERE particle <> ''"
    return f"SELECT doc_id, para, particle, min(ord) AS first_ord, count(*) AS n FROM ({island}) GROUP BY doc_id, para, particle, island HAVING count(*) >= 3"


OPS["rh2_ending_monotony"] = rh2

_prose = lambda d: f"length({d.sub('item', chr(92) + 's', '')})"
OPS |= {
    # A paragraph of 20 characters or more with more passive marks than max(2, 2 per 100 characters).
    "tr1_passive_density": paragraph_op(lambda d: f"length(item) >= 20 and {d.count('item', '被')} > greatest(2, ceil(length(item) / 100.0 * 2))", lambda d: d.count("item", "被")),
    "tr14_one_of_density": paragraph_op(lambda d: f"length(item) >= 100 and {d.count('item', '之一')} >= 2", lambda d: d.count("item", "之一")),
    "ai23_excessive_bold": paragraph_op(lambda d: f"length(item) >= 30 and {d.count('item', '[*][*][^*]+[*][*]')} >= greatest(3, ceil(length(item) / 200.0 * 3))", lambda d: d.count("item", "[*][*][^*]+[*][*]")),
    "ai24_em_dash_overuse": paragraph_op(lambda d: f"{d.count('item', '——')} >= 2", lambda d: d.count("item", "——")),
    "ai27_hedging_density": paragraph_op(
        lambda d: f"{_prose(d)} >= 50 and {d.count('item', '可能|也許|大概|或許|似乎')} >= greatest(3, ceil({_prose(d)} / 200.0 * 3))", lambda d: d.count("item", "可能|也許|大概|或許|似乎")
    ),
    "ai33_golden_contrast": paragraph_op(lambda d: f"{d.count('item', '不是[^，。]{1,14}，而是[^，。]{1,14}。')} >= 3", lambda d: d.count("item", "不是[^，。]{1,14}，而是[^，。]{1,14}。")),
}
