"""The few spellings in which Spark SQL and the SQL of the checking engine differ.

Operators are written once as SQL over these; patterns stay within what both
regular-expression engines read alike (no lookaround, no back-references)
unless an operator says otherwise.
"""

from __future__ import annotations

import re

from .functions.matching import HELD
from .plans.texts import called


class Spark:
    name = "spark"

    def lit(self, s: str) -> str:
        # A word's beginning is one of ASCII, as in the other engine; this one's \\b would take an ideograph before it for a letter.
        s = s.replace(HELD, "+").replace("\\b(", "(?<![A-Za-z0-9_])(")
        return "r'" + s + "'" if "\\" in s else "'" + s + "'"

    def count(self, text: str, pattern: str) -> str:
        return f"regexp_count({text}, {self.lit(pattern)})"

    def all(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({text}, {self.lit(pattern)}, {group})"

    def first(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({text}, {self.lit(pattern)}, {group})"

    def has(self, text: str, pattern: str) -> str:
        return f"({text} rlike {self.lit(pattern)})"

    def sub(self, text: str, pattern: str, to: str) -> str:
        return f"regexp_replace({text}, {self.lit(pattern)}, {self.lit(to.replace(chr(92), '$'))})"

    def explode(self, source: str, array: str, keep: str = "doc_id") -> str:
        """(keep, ord from 0, item) of an array column of a relation.

        An outer explode: the optimiser would test a plain one's array for emptiness below it, and so evaluate it three times.
        """
        return f"(SELECT {keep}, pos AS ord, col AS item FROM (SELECT {keep}, posexplode_outer({array}) FROM {source}) WHERE pos IS NOT NULL)"

    def hits(self, source: str, text: str, pattern: str, keep: str = "doc_id") -> str:
        """(hit_row, keep, ord from 0, start from 0, item) of all matches, in one reading of the text.

        ``hit_row`` tells rows of the relation apart, whatever their ids are.
        """
        found = f"(SELECT hit_row, {keep}, {called('hits', text, self.plain(pattern))} AS hits_of FROM (SELECT *, monotonically_increasing_id() AS hit_row FROM {source}))"
        return f"(SELECT hit_row, {keep}, ord, hit.start AS start, hit.item AS item FROM (SELECT hit_row, {keep}, posexplode_outer(hits_of) AS (ord, hit) FROM {found}) WHERE hit IS NOT NULL)"

    def plain(self, pattern: str) -> str:
        """A literal of the pattern as it is spelled."""
        return "r'" + pattern + "'" if "\\" in pattern else "'" + pattern + "'"

    def spliced(self, text: str, pattern: str, to: str) -> str:
        """The text with each match x replaced by the expression ``to`` of x."""
        return f"array_join(zip_with({self.split(text, pattern)}, {self.all(text, pattern)}, (g, x) -> concat(g, coalesce({to}, ''))), '')"

    def struct(self, **fields: str) -> str:
        return "to_json(named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + "))"

    def rows(self, source: str, keep: str, names: tuple[str, ...], rows: list[tuple[str, ...]]) -> str:
        """Several rows of expressions for each row of a relation, in one scan."""
        body = ", ".join("struct(" + ", ".join(f"{v} AS {n}" for v, n in zip(r, names)) + ")" for r in rows)
        return f"(SELECT {keep}, r.* FROM (SELECT {keep}, explode_outer(array({body})) AS r FROM {source}))"

    def split(self, text: str, mark: str) -> str:
        return f"split({text}, {self.lit(mark)})"

    def size(self, array: str) -> str:
        return f"size({array})"

    def item(self, array: str, place: int) -> str:
        """An item of an array, counted from 1; null beyond its end."""
        return f"try_element_at({array}, {place})"

    def join(self, array: str, mark: str) -> str:
        return f"array_join({array}, '{mark}')"

    def bytes(self, text: str) -> str:
        return f"octet_length({text})"

    def sha(self, text: str) -> str:
        return f"sha2({text}, 256)"

    def joined(self, item: str, order: str, mark: str = "|") -> str:
        return f"array_join(transform(array_sort(collect_list(struct({order}, {item} AS v))), x -> x.v), '{mark}')"

    def filter(self, array: str, var: str, cond: str) -> str:
        return f"filter({array}, {var} -> {cond})"

    def map(self, array: str, var: str, to: str) -> str:
        return f"transform({array}, {var} -> {to})"

    def largest(self, array: str) -> str:
        return f"array_max({array})"

    def json(self, text: str, path: str) -> str:
        return f"get_json_object({text}, '{path}')"

    def distinct(self, array: str) -> str:
        return f"size(array_distinct({array}))"


class Duck(Spark):
    name = "duck"

    def lit(self, s: str) -> str:
        return "'" + s.replace(HELD, "") + "'"

    def count(self, text: str, pattern: str) -> str:
        return f"len(regexp_extract_all({text}, {self.lit(pattern)}))"

    def has(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, {self.lit(pattern)})"

    def sub(self, text: str, pattern: str, to: str) -> str:
        return f"regexp_replace({text}, {self.lit(pattern)}, {self.lit(to)}, 'g')"

    def explode(self, source: str, array: str, keep: str = "doc_id") -> str:
        return f"(SELECT {keep}, unnest(range(len(a))) AS ord, unnest(a) AS item FROM (SELECT {keep}, {array} AS a FROM {source}))"

    def hits(self, source: str, text: str, pattern: str, keep: str = "doc_id") -> str:
        pieces = f"SELECT row_number() OVER () AS hit_row, {keep}, {self.all(text, pattern)} AS found, {self.split(text, pattern)} AS gaps FROM {source}"
        return self._placed(f"(SELECT hit_row, {keep}, unnest(range(len(found))) AS ord, unnest(found) AS item, length(unnest(gaps[1:len(found)])) AS gap FROM ({pieces}))", keep)

    def _placed(self, rows: str, keep: str) -> str:
        before = f"OVER (PARTITION BY hit_row ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        return f"(SELECT hit_row, {keep}, ord, CAST(sum(gap + length(item)) {before} AS BIGINT) - length(item) AS start, item FROM {rows})"

    def spliced(self, text: str, pattern: str, to: str) -> str:
        return f"array_to_string(list_transform(list_zip({self.split(text, pattern)}, {self.all(text, pattern)}), lambda p: p[1] || coalesce({re.sub(chr(92) + 'bx' + chr(92) + 'b', 'p[2]', to)}, '')), '')"

    def struct(self, **fields: str) -> str:
        return "CAST(to_json({" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}) AS VARCHAR)"

    def rows(self, source: str, keep: str, names: tuple[str, ...], rows: list[tuple[str, ...]]) -> str:
        body = ", ".join("{" + ", ".join(f"'{n}': {v}" for v, n in zip(r, names)) + "}" for r in rows)
        return f"(SELECT {keep}, r.* FROM (SELECT {keep}, unnest([{body}]) AS r FROM {source}))"

    def split(self, text: str, mark: str) -> str:
        return f"{'string_split' if len(mark) == 1 else 'regexp_split_to_array'}({text}, {self.lit(mark)})"

    def size(self, array: str) -> str:
        return f"len({array})"

    def item(self, array: str, place: int) -> str:
        return f"({array})[{place}]"

    def join(self, array: str, mark: str) -> str:
        return f"array_to_string({array}, '{mark}')"

    def bytes(self, text: str) -> str:
        return f"strlen({text})"

    def sha(self, text: str) -> str:
        return f"sha256({text})"

    def joined(self, item: str, order: str, mark: str = "|") -> str:
        return f"string_agg({item}, '{mark}' ORDER BY {order})"

    def filter(self, array: str, var: str, cond: str) -> str:
        return f"list_filter({array}, lambda {var}: {cond})"

    def map(self, array: str, var: str, to: str) -> str:
        return f"list_transform({array}, lambda {var}: {to})"

    def largest(self, array: str) -> str:
        return f"list_max({array})"

    def json(self, text: str, path: str) -> str:
        return f"json_extract_string({text}, '{path}')"

    def distinct(self, array: str) -> str:
        return f"len(list_distinct({array}))"


SPARK, DUCK = Spark(), Duck()
