"""The registered queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _catalogue():
    from . import catalogue, edits, listed, logs, streams  # noqa: F401 - each adds its queries to the catalogue

    return catalogue


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_catalogue().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_catalogue().SQL)
