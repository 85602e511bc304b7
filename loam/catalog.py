"""All registered queries, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ("preparation", "windowing", "detection", "comparison", "choosing", "streams")


def _all(kind: str) -> dict:
    found: dict = {}
    for family in FAMILIES:
        found |= getattr(import_module(f"loam.plans.{family}"), kind)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
