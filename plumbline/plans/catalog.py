"""Every registered query outside the corpus subpackage, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

GROUPS = ("web", "documents", "series", "commerce", "control", "reading", "registries", "rules")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _group in GROUPS:
    _module = import_module(f"plumbline.plans.{_group}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
