"""All registered queries of the library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cueloom.plans import alignment, checked, labelled, layouts, mixed, placed, registered, synced, wrapped  # noqa: F401  (the others add their queries to those of registered)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registered.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registered.SQL)
