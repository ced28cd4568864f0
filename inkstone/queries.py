"""Registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import contexts, conversion, detectors, documents, engine, fixing, lexical, passages, policies, reports, resolving, rule_scan, scan_cache, shapes, signature, stores, structure, translation
from .plans.registered import duck_sql, spark_query, with_zh

OPS = contexts.OPS | detectors.OPS | lexical.OPS | documents.OPS | passages.OPS | policies.OPS | reports.OPS | shapes.OPS | signature.OPS | stores.OPS | translation.OPS
QUERIES = {name: spark_query(sql) for name, sql in OPS.items()} | engine.QUERIES | conversion.QUERIES | fixing.QUERIES | resolving.QUERIES | rule_scan.QUERIES | scan_cache.QUERIES | structure.QUERIES
ORACLE_SQL = {name: duck_sql(sql) for name, sql in OPS.items()} | engine.ORACLE_SQL | structure.ORACLE_SQL | {"pre9_script_gate": with_zh(conversion.PRE9_SQL)}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the vocabulary by document and kind."""
    return QUERIES["lex2_spelling"](spark, sf_dir)
