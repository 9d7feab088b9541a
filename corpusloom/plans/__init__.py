"""Registered queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["data_cleaning", "frequency_queries", "corpus_queries", "passage_queries", "network_queries", "task_queries", "stream_queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"{__name__}.{m}").SQL.items()}
