"""Machine-writing score by structural families: which kinds of evidence a text shows, and what each may add.

A family is a kind of finding; a text shows it or not, however often.  Families of
layout are capped apart from those of prose, and two families (mixed address,
stacked 請) are defects but no evidence.  Findings without a family add their
density.  The score is the sum of phrases (to 0.7), families (to 0.3 and 0.15),
density (to 0.3), invisible characters (to 0.2) and punctuation (to 0.1), at most 1.
"""

from __future__ import annotations

from collections.abc import Callable

from ..dialect import Spark
from ..plans.registered import Names
from . import contexts, detectors, documents, reports, shapes
from .documents import sentence_families, signals

_OPS = contexts.OPS | detectors.OPS | documents.OPS | reports.OPS | shapes.OPS
#: Families by the operator whose finding shows them; layout, and what is no evidence, apart.
PROSE = (
    "ai8_binary_contrast ai9_paragraph_endings ai10_dash_overuse ai17_tricolon ai18_negative_parallel ai19_section_closers ai20_significance_stamp ai21_era_opener ai24_em_dash_overuse "
    "ai25_formulaic_despite ai26_false_range ai28_line_metaphor ai29_repeated_slogan ai30_rhetorical_question ai31_colon_reveal ai32_question_reveal ai33_golden_contrast ai34_psych_verdict "
    "ai35_fake_candor ai36_opening_announcement ai37_stock_conclusion ai38_fake_depth"
).split()
LAYOUT = "ai11_formulaic_headings ai12_list_density ai22_mechanical_bullets ai23_excessive_bold".split()
NO_EVIDENCE = "ai13_mixed_address ai14_stacked_please".split()
#: Findings of machine style that have no family.
LOOSE = "ai1_implication ai2_copula_avoidance ai3_passive_rewrite ai4_didactic ai5_vague_exaggeration".split()
LEAST_CHARS = 500


def families(d: Spark, t: Names) -> str:
    """(doc_id, family, side): each family that a text shows."""
    if d.name == "spark":
        # The detectors of one reading are asked at once.
        at_once = [n for n in PROSE if n in shapes.SHAPES]
        named = "CASE detector " + " ".join(f"WHEN '{n}' THEN '{n.split('_', 1)[1]}'" for n in at_once) + " END"
        spoken = ("ai19_section_closers", "ai29_repeated_slogan", "ai30_rhetorical_question", "ai32_question_reveal", "ai37_stock_conclusion")
        rest = [(n, "prose") for n in PROSE if n not in at_once and n not in spoken] + [(n, "layout") for n in LAYOUT] + [(n, "none") for n in NO_EVIDENCE]
        each = [f"SELECT doc_id, {named} AS family, 'prose' AS side FROM {shapes.detected(t.zh, at_once)}", f"SELECT doc_id, substring(name, instr(name, '_') + 1) AS family, 'prose' AS side FROM {sentence_families(d, t)}"] + [f"SELECT doc_id, '{n.split('_', 1)[1]}' AS family, '{side}' AS side FROM ({_OPS[n](d, t)})" for n, side in rest]
        return f"(SELECT DISTINCT doc_id, family, side FROM ({' UNION ALL '.join(each)}))"
    sides = [(n, "prose") for n in PROSE] + [(n, "layout") for n in LAYOUT] + [(n, "none") for n in NO_EVIDENCE]
    return "(" + " UNION ALL ".join(f"SELECT DISTINCT doc_id, '{n.split('_', 1)[1]}' AS family, '{side}' AS side FROM ({_OPS[n](d, t)})" for n, side in sides) + ")"


def loose(d: Spark, t: Names) -> str:
    """(doc_id, n): findings of machine style without a family."""
    if d.name == "spark":
        at_once = [n for n in LOOSE if n in shapes.SHAPES]
        each = [f"SELECT doc_id FROM {shapes.detected(t.zh, at_once)}"] + [f"SELECT doc_id FROM ({_OPS[n](d, t)})" for n in LOOSE if n not in at_once]
        return f"(SELECT doc_id, count(*) AS n FROM ({' UNION ALL '.join(each)}) GROUP BY doc_id)"
    return "(SELECT doc_id, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id FROM ({_OPS[n](d, t)})" for n in LOOSE) + ") GROUP BY doc_id)"


def sc1_families(d: Spark, t: Names) -> str:
    """Families that each text shows, by side."""
    return f"SELECT doc_id, family, side FROM {families(d, t)}"


def sc1_signature(d: Spark, t: Names) -> str:
    """The score of texts of 500 characters or more, with its parts."""
    shown = f"(SELECT doc_id, sum(CASE WHEN side = 'prose' THEN 1 ELSE 0 END) AS prose, sum(CASE WHEN side = 'layout' THEN 1 ELSE 0 END) AS layout FROM {families(d, t)} GROUP BY doc_id)"
    marks = f"(SELECT doc_id, max(part) AS part FROM ({contexts.sc4(d, t)}) GROUP BY doc_id)"
    rows = f"""SELECT s.doc_id, s.chars, coalesce(f.prose, 0) AS prose, coalesce(f.layout, 0) AS layout,
        0.7 * least(1.0, CASE WHEN s.present = 0 THEN 0.0 ELSE s.excess / s.present END) AS phrases, coalesce(l.n, 0) * 1000.0 / s.chars AS per_1000,
        least(0.2, s.invisible / 3.0 * 0.2) AS hidden, coalesce(m.part, 0.0) AS punctuation
      FROM {signals(d, t)} s LEFT JOIN {shown} f ON s.doc_id = f.doc_id LEFT JOIN {loose(d, t)} l ON s.doc_id = l.doc_id LEFT JOIN {marks} m ON s.doc_id = m.doc_id WHERE s.chars >= {LEAST_CHARS}"""
    structure = "least(0.3, prose * 0.1) + least(0.15, layout * 0.05)"
    density = "CASE WHEN per_1000 > 2.0 THEN least(0.3, (per_1000 - 2.0) / 5.0) ELSE 0.0 END"
    return f"SELECT doc_id, CAST(prose AS BIGINT) AS prose, CAST(layout AS BIGINT) AS layout, round(least(1.0, phrases + {structure} + {density} + hidden + punctuation), 5) AS score FROM ({rows})"


OPS: dict[str, Callable[[Spark, Names], str]] = {"sc1_structural_families": sc1_families, "sc1_signature": sc1_signature}
