"""Functions of one text that SQL calls by name: read once, in Arrow batches next to the scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import matching

#: Texts that are Python strings at once.
SLICE = 128


def _each(column: pa.Array) -> Iterator[str | None]:
    for i in range(0, len(column), SLICE):
        yield from column.slice(i, SLICE).to_pylist()


def _lists(texts: pa.Array, fields: list[tuple[str, pa.DataType]], make: Callable[[str], Iterable[tuple]]) -> pa.Array:
    """For each text the list of rows that ``make`` gives; rows are kept as columns."""
    ends, columns = [0], [[] for _ in fields]
    done: list[list[pa.Array]] = [[] for _ in fields]
    held = 0

    def flush() -> None:
        for i, (_, kind) in enumerate(fields):
            done[i].append(pa.array(columns[i], kind))
            columns[i].clear()

    for text in _each(texts):
        if text:
            for row in make(text):
                held += 1
                for column, value in zip(columns, row):
                    column.append(value)
        ends.append(held)
        if len(columns[0]) > 65536:
            flush()
    flush()
    rows = pa.StructArray.from_arrays([pa.concat_arrays(x) for x in done], [name for name, _ in fields])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def _hits(texts: pa.Array, pattern: pa.Array) -> pa.Array:
    said = pattern[0].as_py() if len(pattern) else ""
    return _lists(texts, [("start", pa.int64()), ("item", pa.string())], lambda t: [(a, t[a:b]) for a, b in matching.hits(t, said)])


_FOUND = [("detector", pa.string()), ("start", pa.int64()), ("found", pa.string()), ("suggestion", pa.string()), ("kind", pa.string()), ("severity", pa.int32())]


def _found(texts: pa.Array, names: pa.Array, behind: pa.Array) -> pa.Array:
    from ..operators.shapes import found_in

    said, masked = (names[0].as_py().split(), behind[0].as_py()) if len(names) else ([], False)
    return _lists(texts, _FOUND, lambda t: found_in(t, said, masked))


def _masked(texts: pa.Array) -> pa.Array:
    return pa.array((t and matching.masked(t) for t in _each(texts)), pa.string())


def _restated(texts: pa.Array) -> pa.Array:
    from ..operators.passages import restated_text

    return pa.array((t and restated_text(t) for t in _each(texts)), pa.string())


def _fixed(texts: pa.Array) -> pa.Array:
    from ..operators.policies import fixed_text

    return pa.array((t and fixed_text(t) for t in _each(texts)), pa.string())


def _units(texts: pa.Array) -> pa.Array:
    from ..operators.passages import units_of

    return _lists(texts, [("para", pa.int64()), ("ord", pa.int32()), ("start", pa.int64()), ("body", pa.string()), ("quoted", pa.bool_())], units_of)


def _slogans(texts: pa.Array) -> pa.Array:
    from ..operators.passages import slogans_of

    return _lists(texts, [("first", pa.int64()), ("body", pa.string()), ("n", pa.int64())], slogans_of)


def _pairs(texts: pa.Array, needs: pa.Array) -> pa.Array:
    from ..operators.passages import pairs_of

    said = needs[0].as_py() if len(needs) else ""
    fields = [("para", pa.int64()), ("ord", pa.int32()), ("start", pa.int64()), ("body", pa.string()), ("quoted", pa.bool_()), ("faq", pa.int32()), ("question", pa.string()), ("answer", pa.string())]
    return _lists(texts, fields, lambda t: pairs_of(t, said))


def _sentence_families(texts: pa.Array) -> pa.Array:
    from ..operators.documents import sentence_families_of

    return _lists(texts, [("name", pa.string()), ("para", pa.int32()), ("last", pa.int32()), ("n", pa.int32()), ("item", pa.string())], sentence_families_of)


_SIGNALS = "chars passive weak pronouns chain".split()


def _translated(texts: pa.Array) -> pa.Array:
    from ..operators.translation import signals_of

    rows = [signals_of(t) if t else (0,) * len(_SIGNALS) for t in _each(texts)]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int32()) for i in range(len(_SIGNALS))], _SIGNALS)


#: By name: the function, and what it returns.
FUNCTIONS = {
    "hits": (_hits, "array<struct<start: bigint, item: string>>"),
    "found": (_found, "array<struct<detector: string, start: bigint, found: string, suggestion: string, kind: string, severity: int>>"),
    "masked": (_masked, "string"),
    "restated": (_restated, "string"),
    "fixed": (_fixed, "string"),
    "slogans": (_slogans, "array<struct<first: bigint, body: string, n: bigint>>"),
    "pairs": (_pairs, "array<struct<para: bigint, ord: int, start: bigint, body: string, quoted: boolean, faq: int, question: string, answer: string>>"),
    "translated": (_translated, "struct<chars: int, passive: int, weak: int, pronouns: int, chain: int>"),
    "sentence_families": (_sentence_families, "array<struct<name: string, para: int, last: int, n: int, item: string>>"),
    "units": (_units, "array<struct<para: bigint, ord: int, start: bigint, body: string, quoted: boolean>>"),
}


def register(spark: SparkSession) -> None:
    """The functions as a session's own, by the names that ``called`` gives."""
    for name, (f, returns) in FUNCTIONS.items():
        # Said to be nondeterministic, so that the optimiser never calls one twice for a row.
        spark.udf.register(f"ink_{name}", F.arrow_udf(f, returns).asNondeterministic())


def called(name: str, *arguments: str) -> str:
    """A call in SQL of the active session."""
    session = SparkSession.getActiveSession()
    if session is not None:
        register(session)
    return f"ink_{name}({', '.join(arguments)})"
