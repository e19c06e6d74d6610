"""Registered queries: each an operator on the projected relations, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans.projection import oracle, snapshot
from codeloom.plans.snapshot import Snapshot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A common table expression of the current graph's classes.
CUR = "cur AS (SELECT * FROM classes WHERE lifecycle = 'current' AND origin <> 'orphan_output')"


def register(name: str, operator: Callable[[Snapshot], DataFrame], sql: str | None = None) -> None:
    """Add a query; ``sql`` may name projected relations and driver tables."""
    QUERIES[name] = lambda spark, sf_dir: operator(snapshot(spark, sf_dir))
    if sql:
        ORACLES[name] = oracle(sql)


def filled(df: DataFrame, *columns: str) -> DataFrame:
    """Null numbers as -1, so that a comparison of results needs no nullable integers."""
    return df.fillna(-1, list(columns))


def load() -> None:
    """Import the modules that register queries."""
    from codeloom.catalogue import bounded, change, graphs, history, metrics, rules, search, workspace  # noqa: F401
