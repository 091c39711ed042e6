"""Keep one row per key by order, combining copies before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], chosen: Column, copies: str | None) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    aggregates = [chosen.alias("_row")]
    if copies:
        aggregates.append(F.count("*").alias(copies))
    picked = df.groupBy(*keys).agg(*aggregates)
    columns = [F.col(f"_row.`{c}`").alias(c) if c in others else F.col(c) for c in df.columns]
    return picked.select(*columns, *([copies] if copies else []))


def first_wins(df: DataFrame, keys: Sequence[str], order: Column, copies: str | None = None) -> DataFrame:
    """The first row of each key by ``order``; optionally the number of rows of the key (WN-1, WN-3)."""
    others = [c for c in df.columns if c not in keys]
    return _pick(df, keys, F.min_by(F.struct(*others), order), copies)


def last_wins(df: DataFrame, keys: Sequence[str], order: Column, copies: str | None = None) -> DataFrame:
    """The last row of each key by ``order`` (WN-2, WN-7)."""
    others = [c for c in df.columns if c not in keys]
    return _pick(df, keys, F.max_by(F.struct(*others), order), copies)
