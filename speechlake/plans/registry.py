"""Registered queries and their SQL, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from speechlake.plans import assembly, evaluation, operations, registry_queries, reports, speakers, streams

_MODULES = (evaluation, speakers, assembly, operations, registry_queries, reports, streams)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
