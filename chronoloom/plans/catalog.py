"""All queries over the driver's tables, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoloom.plans import audits, cuts, details, library, ranges, revisions, signal, texts, timeline

FAMILIES = (signal, ranges, library, texts, audits, timeline, details, cuts, revisions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for family in FAMILIES for name, (f, _) in family.REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, (_, sql) in family.REGISTRY.items() if sql}
