"""Queries by name, each with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cladeledger.workload.fixtures import TABLES, oracle_text

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, uses: str = "", oracle: str | None = None, ctes: str = "") -> Callable[[Run], Run]:
    """Register ``name``; ``uses`` names the derived tables that the oracle reads, ``ctes`` adds more."""
    def register(run: Run) -> Run:
        QUERIES[name] = Query(run, None if oracle is None else with_tables(uses, oracle, ctes))
        return run

    return register


def with_tables(uses: str, text: str, ctes: str = "") -> str:
    parts = [f"{name} as ({oracle_text(name)})" for name in uses.split()]
    assert all(name in TABLES for name in uses.split())
    if ctes:
        parts.append(ctes)
    return f"with recursive {', '.join(parts)} {text}" if parts else text
