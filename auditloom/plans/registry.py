"""Collects the per-workload query modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = [
    "q_completions",
    "q_scan",
    "q_dependencies",
    "q_graph",
    "q_policy",
    "q_pii",
    "q_outcomes",
    "q_flows",
]


def _load():
    return [importlib.import_module(f"auditloom.plans.{name}") for name in MODULES]


def all_queries() -> dict[str, Query]:
    merged: dict[str, Query] = {}
    for module in _load():
        merged.update(module.QUERIES)
    return merged


def all_oracles() -> dict[str, str]:
    merged: dict[str, str] = {}
    for module in _load():
        merged.update(module.ORACLE)
    return merged
