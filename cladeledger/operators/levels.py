"""Space levels with hysteresis over an ordered series of measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeledger.fixed_values import RECOVERY_MARGIN
from cladeledger.functions.space import level_name, level_rank
from cladeledger.ordering import MAX_GROUP_ROWS, with_last_known


def hysteresis_levels(
    metrics: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    fraction: Column,
    free_bytes: Column | None = None,
    start_rank: Column | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add ``level_rank`` and ``level`` after each measurement (ST-3, batch form).

    A worse level applies at once; a better one only if it also holds with the fraction reduced by the
    margin. So "at least level k" becomes true when the plain level reaches k, false when the reduced
    one is below k, and else stays: a last known value per k, for any split of the series.
    """
    plain = level_rank(fraction, free_bytes)
    reduced = level_rank(fraction - RECOVERY_MARGIN, free_bytes)
    names = {f"_at_least_{k}": k for k in (1, 2, 3)}
    signals = {n: F.when(plain >= k, 1).when(reduced < k, 0) for n, k in names.items()}
    known = with_last_known(metrics, keys, order, signals, max_group_rows)
    start = F.lit(0) if start_rank is None else F.coalesce(start_rank, F.lit(0))
    rank = F.lit(0)
    for name, k in names.items():
        rank = rank + F.coalesce(F.col(name), F.when(start >= k, 1).otherwise(0))
    return known.withColumn("level_rank", rank).withColumn("level", level_name(F.col("level_rank"))).drop(*names)
