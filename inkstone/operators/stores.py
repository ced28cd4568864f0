"""Rule layers, their checks, and the stores of decisions, as tables.

Rules are rows with a layer; here they are derived from the ``part`` table, one
definition a row, with faults of every sort among them (no source, no target, a
target that is a source, one source in several layers).  Decisions are a log with
times, read from ``events``.  A store's state is the last row of each key; what
runs out goes by its age against the newest row.

Nothing is collected into one group: the hash of a rule set is a hash of hashes of
256 parts, and checks of rules against rules are joins by equal strings.
"""

from __future__ import annotations

from collections.abc import Callable

from ..dialect import Spark
from ..plans.registered import Names

#: The newest entries that a store keeps, and the age after which a judgment counts no more.
MOST, DAYS = 10_000, 14


def rules(d: Spark, t: Names) -> str:
    """(rule_id, source, target, kind, severity, english, layer, clues, tags, disabled): the definitions of all layers."""
    name = "concat(p_name, ' ', p_brand)"
    return f"""(SELECT p_partkey AS rule_id, CASE WHEN p_size = 1 THEN '' ELSE {name} END AS source,
      CASE WHEN p_size <= 4 THEN '' WHEN p_size >= 48 THEN {name} WHEN p_size = 40 THEN concat('red widget ', p_brand) WHEN p_size = 30 THEN concat(p_brand, chr(34))
        WHEN p_size BETWEEN 20 AND 25 THEN concat(lower(p_type), '/', p_brand) ELSE lower(p_type) END AS target,
      CASE WHEN p_type = 'ECONOMY' THEN 'cross_strait' WHEN p_type = 'STANDARD' THEN 'confusable' WHEN p_type = 'PROMO' THEN 'ai_filler' ELSE 'variant' END AS kind,
      1 + p_size % 3 AS severity, CASE WHEN p_retailprice > 950 THEN p_name ELSE '' END AS english, p_size % 4 AS layer,
      CASE WHEN p_size % 5 = 0 THEN concat(p_type, '/', p_brand) ELSE '' END AS clues, lower(p_type) AS tags, p_size = 50 AS disabled FROM {t.part})"""


def last(d: Spark, t: Names) -> str:
    """Rules with the last layer's definition of each source; sources that it disables are gone."""
    ranked = f"SELECT *, row_number() OVER (PARTITION BY source ORDER BY layer DESC, rule_id DESC) AS k, min(rule_id) OVER (PARTITION BY source) AS first_id FROM {rules(d, t)}"
    return f"(SELECT * FROM ({ranked}) WHERE k = 1 AND NOT disabled)"


def pol1(d: Spark, t: Names) -> str:
    """Spelling layers merged: the last definition of each source, in the first one's place."""
    return f"SELECT source, target, layer, first_id FROM {last(d, t)}"


def pol2(d: Spark, t: Names) -> str:
    """Case layers merged on the lower-cased term: the last layer's spelling counts."""
    terms = f"(SELECT p_brand || ' ' || CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS term, p_size % 4 AS layer, p_partkey AS id FROM {t.part})"
    return f"SELECT key, term, definitions FROM (SELECT lower(term) AS key, term, row_number() OVER (PARTITION BY lower(term) ORDER BY layer DESC, id DESC) AS k, count(*) OVER (PARTITION BY lower(term)) AS definitions FROM {terms}) WHERE k = 1"


def pol4(d: Spark, t: Names) -> str:
    """Packs in conflict: a layer that gives a source another target than the definer before."""
    return f"SELECT source, rule_id, layer, before, target FROM (SELECT *, lag(target) OVER (PARTITION BY source ORDER BY layer, rule_id) AS before FROM {rules(d, t)}) WHERE before <> target"


def pol5(d: Spark, t: Names) -> str:
    """Rules that break the schema, with what they break."""
    faults = "source = '' AS no_source, source = target AS same, target = '' AND english = '' AND kind <> 'ai_filler' AS nothing, severity NOT IN (1, 2, 3) AS no_severity"
    return f"SELECT * FROM (SELECT rule_id, {faults} FROM {rules(d, t)}) WHERE no_source OR same OR nothing OR no_severity"


def pol14(d: Spark, t: Names) -> str:
    """Explanation of a rule: its domain, whether a fix is safe, whether a person must look, and why."""
    several, clued = "instr(target, '/') > 0", "clues <> ''"
    why = f"CASE WHEN {several} AND {clued} THEN 'several targets and clues' WHEN {several} THEN 'several targets' WHEN {clued} THEN 'clues' WHEN target = '' AND kind <> 'ai_filler' THEN 'no target' ELSE 'one target' END"
    domain = "CASE WHEN kind IN ('cross_strait', 'confusable') THEN 'regional' WHEN kind = 'ai_filler' THEN 'style' ELSE 'spelling' END"
    return f"SELECT source, {domain} AS domain, {why} = 'one target' AS auto_fix_safe, {several} OR {clued} AS needs_review, {why} AS reason FROM {last(d, t)} WHERE source <> ''"


def pol17(d: Spark, t: Names) -> str:
    """Hash of the merged rules: every field of every rule counts, in parts by a hash of the source."""
    fields = "concat(source, '>', target, '>', kind, '>', cast(severity AS string), '>', english, '>', clues, '>', tags)"
    parts = f"SELECT substring(md5(source), 1, 2) AS part, {d.sha(d.joined(fields, 'source', ';'))} AS h FROM {last(d, t)} GROUP BY substring(md5(source), 1, 2)"
    return f"SELECT {d.sha(d.joined('h', 'part', ';'))} AS ruleset, count(*) AS parts FROM ({parts})"


def pol18(d: Spark, t: Names) -> str:
    """Rule checks: repeated and conflicting definitions, targets that are sources of their own, and sources inside longer ones, by whole words."""
    merged = f"(SELECT source, target FROM {last(d, t)} WHERE source <> '')"
    twice = f"SELECT source, CASE WHEN count(DISTINCT target) > 1 THEN 'conflict' ELSE 'duplicate' END AS fault, cast(count(*) AS string) AS other FROM {rules(d, t)} WHERE source <> '' GROUP BY source HAVING count(*) > 1"
    chain = f"SELECT a.source, 'chain' AS fault, b.source AS other FROM {merged} a JOIN {merged} b ON a.target = b.source AND a.source <> b.source"
    # Shorter runs of a source's three words.
    runs = d.rows(f"(SELECT source, {d.split('source', ' ')} AS w FROM {merged})", "source", ("run",), [(f"concat({d.item('w', i)}, ' ', {d.item('w', i + 1)})",) for i in (1, 2)])
    return f"{twice} UNION ALL {chain} UNION ALL SELECT a.source, 'shadow' AS fault, b.source AS other FROM {merged} a JOIN {runs} b ON a.source = b.run"


def lex4(d: Spark, t: Names) -> str:
    """Rules ready for a scan: merged, without those that a detector owns or a profile leaves out, clues without repetition."""
    return f"SELECT rule_id, source, target, kind, layer, CASE WHEN clues = '' THEN 0 ELSE {d.distinct(d.split('clues', '/'))} END AS n_clues FROM {last(d, t)} WHERE source <> '' AND NOT (kind = 'ai_filler' AND clues <> '') AND kind <> 'variant'"


def lex14(d: Spark, t: Names) -> str:
    """Effective suggestions: the targets that aren't empty, a deletion for fillers, else the English gloss."""
    return f"SELECT source, CASE WHEN target <> '' THEN target WHEN kind = 'ai_filler' THEN '' WHEN english <> '' THEN english END AS suggestion, CASE WHEN target <> '' THEN {d.size(d.split('target', '/'))} WHEN kind = 'ai_filler' OR english <> '' THEN 1 ELSE 0 END AS arity FROM {last(d, t)}"


def lex18(d: Spark, t: Names) -> str:
    """Phrases that a procedural detector owns, with the severity they carry."""
    return f"SELECT source, kind, severity FROM {last(d, t)} WHERE kind = 'ai_filler' AND clues <> '' AND source <> ''"


def fx3(d: Spark, t: Names) -> str:
    """Suggestions that may stand in a JSON string."""
    return f"SELECT source, target, NOT {d.has('target', chr(91) + chr(92) + 'x22' + chr(92) + 'x5C' + chr(92) + 'x00-' + chr(92) + 'x1f]')} AS admissible FROM {last(d, t)}"


def da6(d: Spark, t: Names) -> str:
    """Promoted suggestions: the one that a decision of the log names goes first, the others follow."""
    rest = d.filter(d.split("target", "/"), "x", "x <> chosen")
    chosen = f"SELECT source, target, CASE WHEN severity = 1 THEN {d.item(d.split('target', '/'), 1)} ELSE {d.item(d.split('target', '/'), 2)} END AS chosen FROM {last(d, t)} WHERE instr(target, '/') > 0"
    return f"SELECT source, chosen, {d.size(rest)} AS others, concat(chosen, '/', {d.join(rest, '/')}) AS promoted FROM ({chosen})"


def log(t: Names) -> str:
    """(seq, key, action, value, made): decisions in the order of their times."""
    return f"(SELECT event_id AS seq, concat('t', cast(user_id AS string)) AS key, event_type AS action, props AS value, ts AS made FROM {t.events})"


def newest(t: Names, where: str = "true") -> str:
    """The last row of each key."""
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY made DESC, seq DESC) AS k, count(*) OVER (PARTITION BY key) AS n FROM {log(t)} WHERE {where}) WHERE k = 1)"


def st1(d: Spark, t: Names) -> str:
    """Overrides after a log of upserts, disablings and deletions: the last word on each key; deleted keys are gone."""
    return f"SELECT key, value, action <> 'view' AS enabled, n AS changes FROM {newest(t)} WHERE action <> 'error'"


def st2(d: Spark, t: Names) -> str:
    """Suppressed terms after additions, removals and a clearing: nothing from before the last clearing counts."""
    cleared = f"(SELECT max(made) FROM {log(t)} WHERE action = 'purchase' AND value = '{{\"k\": 0}}')"
    kept = f"SELECT * FROM {log(t)} WHERE action IN ('click', 'error') AND coalesce(made > {cleared}, true)"
    return f"SELECT key FROM (SELECT key, action, row_number() OVER (PARTITION BY key ORDER BY made DESC, seq DESC) AS k FROM ({kept})) WHERE k = 1 AND action = 'click'"


def st3(d: Spark, t: Names) -> str:
    """Translation memory: the latest decision for each term, the newest ten thousand terms."""
    return f"SELECT key, value, n AS decisions FROM {newest(t)} ORDER BY made DESC, seq DESC LIMIT {MOST}"


def st4(d: Spark, t: Names) -> str:
    """Import of a memory into another: what is added, what changes and what stays."""
    ours, theirs = newest(t, "action = 'click'"), newest(t, "action = 'view'")
    state = "CASE WHEN o.key IS NULL THEN 'added' WHEN i.key IS NULL THEN 'kept' WHEN o.value <> i.value THEN 'updated' ELSE 'same' END"
    return f"SELECT state, count(*) AS n FROM (SELECT {state} AS state FROM {ours} o FULL OUTER JOIN {theirs} i ON o.key = i.key) GROUP BY state"


def st5(d: Spark, t: Names) -> str:
    """Judgments kept: those not older than the limit against the newest one, and of them the newest ten thousand."""
    fresh = f"SELECT * FROM {newest(t, 'action = ' + chr(39) + 'error' + chr(39))} WHERE made >= (SELECT max(made) FROM {log(t)}) - INTERVAL '{DAYS}' DAY"
    return f"SELECT key, value FROM ({fresh}) ORDER BY made DESC, seq DESC LIMIT {MOST}"


def st7(d: Spark, t: Names) -> str:
    """Packs: their rules, and whether they may be installed under their names."""
    packs = f"(SELECT *, concat('pack-', tags, '-', cast(layer AS string)) AS pack FROM {rules(d, t)})"
    return f"SELECT pack, count(*) AS rules, count(DISTINCT source) AS sources, {d.has('max(pack)', '^[a-z0-9-]{1,64}$')} AS valid_name, sum(CASE WHEN source = '' OR source = target THEN 1 ELSE 0 END) AS broken FROM {packs} GROUP BY pack"


OPS: dict[str, Callable[[Spark, Names], str]] = {
    "pol1_merge_spelling_layers": pol1, "pol2_merge_case_layers": pol2, "pol4_pack_conflicts": pol4, "pol5_pack_validation": pol5, "pol14_explain": pol14, "pol17_ruleset_hash": pol17, "pol18_ruleset_checks": pol18,
    "lex4_rule_preparation": lex4, "lex14_effective_suggestions": lex14, "lex18_structural_guards": lex18, "fx3_json_admissible": fx3, "da6_promoted_suggestion": da6,
    "st1_override_upsert": st1, "st2_suppression_set": st2, "st3_memory_record": st3, "st4_memory_import": st4, "st5_judgment_eviction": st5, "st7_packs": st7,
}
