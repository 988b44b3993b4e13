"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

MODULES = ("neighbours", "splitting", "conversations", "tokens", "packing", "personal", "names", "residue")


def load() -> list[ModuleType]:
    """All modules; fails if a library that one of them needs is missing."""
    return [import_module(f"lorecast.llm.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in load() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in load() for k, q in m.ORACLE.items()}
