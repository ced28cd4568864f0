"""From an operator's SQL to a Spark query and to the SQL of the checking engine."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..dialect import DUCK, SPARK, Spark
from ..sources.zh_view import ZH_SQL, zh_docs
from .texts import register

TABLES = "documents pages events labels benchmark conversations part".split()


class Names:
    """Names of the relations an operator reads."""

    def __init__(self, suffix: str = "") -> None:
        for t in ("zh", *TABLES):
            setattr(self, t, f"ink_{t}_{suffix}" if suffix else t)


Sql = Callable[[Spark, Names], str]


def _doubles(text: str) -> str:
    """Decimal literals as doubles, so both engines compute in one type."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", text)


def _closed(text: str, at: int) -> int:
    """The place after the parenthesis that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if not depth:
            return i + 1
    raise ValueError("parentheses don't close")


def _long_sums(text: str) -> str:
    """Sums as 64-bit integers, which the checking engine would make wider; all sums here are of integers."""
    out, at = [], 0
    for m in re.finditer(r"(?<![\w])sum(?=\()", text):
        if m.start() < at:
            continue
        end = _closed(text, m.end())
        over = re.match(r" OVER (?=\()", text[end:])
        end = _closed(text, end + over.end()) if over else end
        out += [text[at : m.start()], "CAST(", text[m.start() : end], " AS BIGINT)"]
        at = end
    return "".join([*out, text[at:]])


def spark_query(sql: Sql) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = Names(hashlib.sha256(sf_dir.encode()).hexdigest()[:12])
        register(spark)
        text = _doubles(sql(SPARK, names))
        if names.zh in text:
            zh_docs(spark, sf_dir).createOrReplaceTempView(names.zh)
        for t in TABLES:
            if getattr(names, t) in text:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(getattr(names, t))
        return spark.sql(text)

    run.__doc__ = sql.__doc__
    return run


def duck_sql(sql: Sql) -> str:
    return with_zh(_long_sums(_doubles(sql(DUCK, Names()))).strip())


def with_zh(text: str) -> str:
    """SQL of the checking engine with the Chinese view before it."""
    if text.upper().startswith("WITH "):
        return f"WITH zh AS {ZH_SQL}, {text[5:]}"
    return f"WITH zh AS {ZH_SQL} {text}"
