"""The registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.plans import events, gates, incremental, index, keeping, metrics, pages, retrieval, runs, tables, validators, views

MODULES = (incremental, retrieval, tables, validators, pages, gates, index, keeping, views, events, metrics, runs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
