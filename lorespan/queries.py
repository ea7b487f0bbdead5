"""The registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

GROUPS = ("knowledge", "checks", "stats", "similarity", "lineage", "domain", "segments", "corpus", "audits")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in GROUPS:
        out |= getattr(import_module(f"lorespan.plans.{name}"), what)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("Q")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
