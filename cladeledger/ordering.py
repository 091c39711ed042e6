"""Numbering and running values over ordered rows, without one task per (hot) group.

Groups up to ``max_group_rows`` use a plain window. Rows of larger groups, found by a count first, are
range-partitioned by group and order, so that such a group spans many partitions, and only one small
row per (group, partition) is combined across them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeledger.workspace import materialize

MAX_GROUP_ROWS = 2_000_000
_LOCAL_ROW = (1 << 33) - 1


def tie_break(df: DataFrame) -> Column:
    """A hash over all columns but maps, which have no hash."""
    return F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest group; only the keys are read and counts combine map-side."""
    counts = df.groupBy(*keys).count() if keys else df.agg(F.count("*").alias("count"))
    return counts.agg(F.max("count")).first()[0] or 0


def split_hot(df: DataFrame, keys: Sequence[str], max_group_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups within the limit, and rows of larger groups if there are any.

    At most one key per ``max_group_rows`` rows is hot, so the table of hot keys stays small.
    """
    return split_by(df, keys, df.groupBy(*keys).count().filter(F.col("count") > max_group_rows).drop("count"))


def split_by(df: DataFrame, keys: Sequence[str], chosen: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose keys are not among the ``chosen`` ones, and those whose are, if there are any; nulls are keys."""
    hot = materialize(chosen.withColumnsRenamed({k: f"_hot_{k}" for k in keys}), "hot-keys")
    if hot.isEmpty():
        return df, None
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_hot_{key}"))
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def in_range_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Write ``df`` in range order and add ``_part`` and ``_row``, the place of each row in it."""
    by = [F.col(k) for k in keys] + list(order)
    placed = (
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_ROW)))
    )
    return materialize(placed, "ranged")


def _piece_window(keys: Sequence[str]) -> Window:
    # One row per group and partition reaches this window, never the rows themselves.
    window = Window.partitionBy(*(keys or [F.lit("all")])).orderBy("_part")
    return window.rowsBetween(Window.unboundedPreceding, -1)


def with_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add the 1-based position of each row in its group.

    Rows that ``order`` does not tell apart are taken by a hash of all their columns, so that the numbers are the
    same whatever ``max_group_rows`` sends a group which way; rows equal in everything may change places.
    """
    order = [*order, tie_break(df)]
    if not keys:
        return _row_number_by_range(df, keys, order, name)
    cold, hot = split_hot(df, keys, max_group_rows)
    window = Window.partitionBy(*keys).orderBy(*order)
    numbered = cold.withColumn(name, F.row_number().over(window).cast("bigint"))
    return numbered if hot is None else numbered.unionByName(_row_number_by_range(hot, keys, order, name))


def _row_number_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    ranged = in_range_order(df, keys, order)
    pieces = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    rows_before = F.coalesce(F.sum("_n").over(_piece_window(keys)), F.lit(0))
    pieces = pieces.select(*keys, "_part", (rows_before - F.col("_first") + 1).alias("_offset"))
    return (
        join_pieces(ranged, pieces, keys)
        .withColumn(name, (F.col("_row") + F.col("_offset")).cast("bigint"))
        .drop("_part", "_row", "_offset")
    )


def with_last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    values: dict[str, Column],
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add, per output name, the latest non-null value of its column up to and including each row.

    Rows that ``order`` does not tell apart are taken by a hash of all their columns, as in ``with_row_number``.
    """
    order = [*order, tie_break(df)]
    cold, hot = split_hot(df, keys, max_group_rows)
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = cold.withColumns({n: F.last(c, ignorenulls=True).over(window) for n, c in values.items()})
    if hot is None:
        return filled
    return filled.unionByName(_last_known_by_range(hot.withColumns(values), keys, order, list(values)))


def _last_known_by_range(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], names: Sequence[str]
) -> DataFrame:
    ranged = in_range_order(df, keys, order)
    inside = (
        Window.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last_rows = [
        F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_row"))).alias(f"_last_{n}") for n in names
    ]
    pieces = ranged.groupBy(*keys, "_part").agg(*last_rows)
    carried = [
        F.last(f"_last_{n}", ignorenulls=True).over(_piece_window(keys)).alias(f"_before_{n}") for n in names
    ]
    pieces = pieces.select(*keys, "_part", *carried)
    filled = ranged.withColumns({n: F.last(n, ignorenulls=True).over(inside) for n in names})
    return join_pieces(filled, pieces, keys).withColumns({n: F.coalesce(n, f"_before_{n}") for n in names}).drop(
        "_part", "_row", *[f"_before_{n}" for n in names]
    )


def join_pieces(ranged: DataFrame, pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``ranged`` with the other columns of ``pieces``, which has one row per group and ``_part``; null keys are groups."""
    same = ["_part", *keys]
    pieces = pieces.withColumnsRenamed({c: f"_piece_{c}" for c in same})
    matches = F.col("_part") == F.col("_piece__part")
    for key in keys:
        matches = matches & F.col(key).eqNullSafe(F.col(f"_piece_{key}"))
    return ranged.join(pieces, matches).drop(*[f"_piece_{c}" for c in same])
