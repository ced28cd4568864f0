"""Sentences, paragraphs, lines and clauses as relations (SEG1 to SEG3, SEG8)."""

from __future__ import annotations

from collections.abc import Iterator

from ..dialect import Spark
from ..functions.chars import ENDS, HAN
from ..functions.matching import compiled

#: Stands at a cut; no text holds it.
CUT = "␞"
#: Abbreviations after which a point ends no sentence.
ABBREVIATIONS = "Mr|Mrs|Ms|Dr|Prof|St|vs|etc|No|Fig|Inc|Ltd|Co|Jr|Sr|Vol|pp|ed|al|cf"


def sentences(d: Spark, source: str, text: str = "zh", keep: str = "doc_id") -> str:
    """(keep, ord, item): cut after 。！？； runs, after . ? ! before white space and a capital or ideograph, and at blank lines."""
    held = d.sub(text, rf"\b({ABBREVIATIONS})\.", r"\1" + "␟")
    cut = d.sub(held, f"([{ENDS}]+)", r"\1" + CUT)
    cut = d.sub(cut, rf"([.?!])(\s+)([A-Z{HAN}])", r"\1" + CUT + r"\2\3")
    cut = d.sub(cut, r"\r?\n\r?\n", CUT)
    inner = f"(SELECT {keep}, {d.split(f'replace({cut}, ' + chr(39) + '␟' + chr(39) + ', ' + chr(39) + '.' + chr(39) + ')', CUT)} AS parts FROM {source})"
    return f"(SELECT {keep}, ord, trim(item) AS item FROM {d.explode(inner, 'parts', keep)} WHERE trim(item) <> '')"


def sentences_of(text: str) -> Iterator[tuple[int, str]]:
    """(ord, item) of ``sentences`` of one text."""
    held = compiled(rf"(?<![A-Za-z0-9_])({ABBREVIATIONS})\.").sub("\\1␟", text) if "." in text else text
    cut = compiled(f"([{ENDS}]+)").sub(rf"\1{CUT}", held)
    cut = compiled(rf"([.?!])(\s+)([A-Z{HAN}])").sub(rf"\1{CUT}\2\3", cut)
    cut = compiled(r"\r?\n\r?\n").sub(CUT, cut)
    for i, part in enumerate(cut.replace("␟", ".").split(CUT)):
        if item := part.strip(" "):
            yield i, item


def paragraphs_of(text: str) -> Iterator[tuple[int, str]]:
    """(ord, item) of ``paragraphs`` of one text."""
    return ((i, p) for i, p in enumerate(compiled(r"\r?\n\r?\n").sub(CUT, text).split(CUT)) if p.strip(" "))


def paragraphs(d: Spark, source: str, text: str = "zh", keep: str = "doc_id") -> str:
    cut = d.sub(text, r"\r?\n\r?\n", CUT)
    inner = f"(SELECT {keep}, {d.split(cut, CUT)} AS parts FROM {source})"
    return f"(SELECT {keep}, ord, item FROM {d.explode(inner, 'parts', keep)} WHERE trim(item) <> '')"


def lines(d: Spark, source: str, text: str = "zh", keep: str = "doc_id") -> str:
    inner = f"(SELECT {keep}, {d.split(f'replace({text}, chr(10), ' + chr(39) + CUT + chr(39) + ')', CUT)} AS parts FROM {source})"
    return d.explode(inner, "parts", keep)


def runs(table: str, flag: str, least: int, keep: str = "doc_id") -> str:
    """Runs of at least ``least`` rows in a row with ``flag``: (keep, first_ord, n).  One window by document."""
    return f"""(SELECT {keep}, min(ord) AS first_ord, count(*) AS n FROM (
      SELECT {keep}, ord, ord - row_number() OVER (PARTITION BY {keep} ORDER BY ord) AS island FROM {table} WHERE {flag}
    ) GROUP BY {keep}, island HAVING count(*) >= {least})"""
