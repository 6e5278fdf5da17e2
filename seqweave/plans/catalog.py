"""All queries of the engine's own operators, and their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("search_plans", "scalar_plans", "primer_plans", "inventory_plans", "alignment_plans", "trace_plans", "format_plans", "extension_plans", "table_plans", "placement_plans", "ambiguous_plans", "index_plans")


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(f"{__package__}.{m}").QUERIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
