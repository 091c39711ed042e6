"""Levels with hysteresis as a stream, with the level of each entity in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cladeledger.fixed_values import RECOVERY_MARGIN
from cladeledger.functions.space import level_name, level_rank
from cladeledger.ordering import tie_break
from cladeledger.streaming.state import as_text, checkpoint_of, use_rocksdb

_RANKS = (1, 2, 3)


class LevelState(StatefulProcessor):
    """Keeps the level rank of an entity, and with event time the time up to which it is told."""

    def __init__(self, order: Sequence[str], event_time: bool):
        self._order = list(order)
        self._event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "rank int, told bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        rank, told = self._last.get() if self._last.exists() else (0, None)
        late = np.zeros(len(batch), bool)
        if self._event_time:
            # A measurement from before what has been told already comes too late to change it.
            bound = max(timerValues.getCurrentWatermarkInMs(), -1 if told is None else told)
            late = batch["millis"].to_numpy() < bound
        batch = batch.assign(late=late, level_rank=-1)
        taken = batch[~late].sort_values(self._order, kind="stable")
        if len(taken):
            plain, reduced = taken["plain"].to_numpy(), taken["reduced"].to_numpy()
            ranks = np.zeros(len(taken), np.int64)
            for k in _RANKS:
                signal = pd.Series(np.where(plain >= k, 1.0, np.where(reduced < k, 0.0, np.nan)))
                ranks += signal.ffill().fillna(float(rank >= k)).to_numpy().astype(np.int64)
            batch.loc[taken.index, "level_rank"] = ranks
            told = int(taken["millis"].max()) if self._event_time else 0
            self._last.update((int(ranks[-1]), told))
        yield batch

    def close(self) -> None:
        pass


def levels_of_stream(
    metrics: DataFrame,
    key: str,
    order: Sequence[Column],
    fraction: Column,
    free_bytes: Column | None = None,
    event_time: str | None = None,
    delay: str = "0 seconds",
) -> DataFrame:
    """``metrics`` with ``level_rank``, ``level`` and ``late`` (ST-3); the level of an entity goes on from batch to batch.

    Rows of a later batch count as later. With ``event_time``, a timestamp column, a measurement that is older than
    the watermark (the latest time less ``delay``) or than what its entity has had told is ``late``: it gets no level
    and changes none. One shuffle by entity; an entity's rows of one batch are sorted in one task, so the size of a
    batch (``files_per_batch``) bounds them.
    """
    use_rocksdb(metrics.sparkSession)
    schema = metrics.schema
    by = [f"order_{i}" for i in range(len(order))]
    computed = {
        "plain": level_rank(fraction, free_bytes),
        "reduced": level_rank(fraction - RECOVERY_MARGIN, free_bytes),
        "tie": tie_break(metrics),
        **dict(zip(by, order)),
        "millis": F.unix_millis(event_time) if event_time else F.lit(0).cast("bigint"),
    }
    if event_time:
        metrics = metrics.withWatermark(event_time, delay)
    # Numbered names, as Python takes only some as they are. As text the time column carries no watermark, so Spark does
    # not drop late rows before they are seen here.
    at = metrics.columns.index(key)
    own = [c.alias(f"c{i}") for i, c in enumerate(as_text(metrics, but=(key,)))]
    rows = metrics.select(*own, *[c.alias(name) for name, c in computed.items()])
    out = ", ".join(f"{n} {t}" for n, t in [*rows.dtypes, ("late", "boolean"), ("level_rank", "int")])
    told = rows.groupBy(f"c{at}").transformWithStateInPandas(
        LevelState([*by, "tie"], event_time is not None), out, "Append", "EventTime" if event_time else "None"
    )
    rank = F.when(~F.col("late"), F.col("level_rank"))
    back = [F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]
    return told.select(*back, rank.alias("level_rank"), level_name(rank).alias("level"), F.col("late"))


def track_levels(
    metrics: DataFrame, path: str, key: str, order: Sequence[Column], fraction: Column, free_bytes: Column | None = None,
    event_time: str | None = None, delay: str = "0 seconds", **trigger,
) -> StreamingQuery:
    """Write ``levels_of_stream`` to the folder ``path``, each row once whatever runs again."""
    levels = levels_of_stream(metrics, key, order, fraction, free_bytes, event_time, delay)
    writer = levels.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint_of(path))
    return writer.trigger(**trigger).start(f"{path}/levels")
