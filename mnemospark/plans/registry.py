"""All queries over the given tables, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "job01_hybrid_retrieve"
#: Modules with ``QUERIES`` (name -> function of spark and folder) and ``SQL`` (name -> DuckDB text).
MODULES: tuple[str, ...] = ("q_filters", "q_aggregates", "q_windows", "q_joins", "q_evaluate", "q_jobs", "q_ingest", "q_boosts", "q_details")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"{__package__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"{__package__}.{name}").SQL
    return found
