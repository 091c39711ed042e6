"""Repair tasks as a stream of events, with the state of each task in Spark's state store (ST-2)."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cladeledger.fixed_values import TASK_STATES
from cladeledger.operators.repair import recovered_status
from cladeledger.operators.task_machine import EVENT_FIELDS, START, function_of_event, is_legal
from cladeledger.streaming.state import checkpoint_of, use_rocksdb

OUT = "task_id string, section string, event_id bigint, at_millis bigint, status string, attempts bigint, n_events bigint, n_illegal bigint"
TOLD = ("section", "event_id", "at_millis", "status", "attempts", "n_events", "n_illegal")


class TaskState(StatefulProcessor):
    """Keeps what the watermark has passed as one state, and newer events as they are.

    Events may come out of order as long as the watermark has not passed them. So the state that is told after each
    batch is the settled state followed by the waiting events in their order.
    """

    def __init__(self, states: list[str], start: str, settle: bool):
        self._states, self._start, self._settle = states, states.index(start), settle

    def init(self, handle: StatefulProcessorHandle) -> None:
        settled = "state int, attempts bigint, n_events bigint, n_illegal bigint"
        # Value states hold flat values only, so the waiting events are kept as JSON.
        self._kept = handle.getValueState("kept", f"{settled}, waiting string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Most tasks have a few events in a batch, so plain rows are much cheaper than a frame for each task.
        watermark = timerValues.getCurrentWatermarkInMs() if self._settle else -1
        *settled, kept = self._kept.get() or (self._start, 0, 0, 0, "[]")
        waiting = {e[1]: e for e in json.loads(kept)}
        told: list[tuple] = []
        fresh = [(row.at_millis, row.event_id, *json.loads(row.f), row.legal) for row in rows]
        for event in sorted(fresh, key=lambda e: e[:2]):
            at, event_id, *_, legal = event
            if at < watermark:
                told.append(("late", event_id, at, None, None, None, None))
            elif event_id in waiting:
                told.append(("repeated", event_id, at, None, None, None, None))
            else:
                waiting[event_id] = event
                if not legal:
                    told.append(("illegal", event_id, at, None, None, None, None))
        ordered = sorted(waiting.values(), key=lambda e: tuple(e[:2]))
        past = [e for e in ordered if e[0] < watermark]
        settled = self._after(tuple(settled), past)
        rest = ordered[len(past) :]
        self._kept.update((*settled, json.dumps(rest)))
        state, attempts, n_events, n_illegal = self._after(settled, rest)
        if n_events:
            told.append(("state", None, None, self._states[state], attempts, n_events, n_illegal))
        for row in told:
            yield Row(task_id=key[0], **dict(zip(TOLD, row)))

    @staticmethod
    def _after(now: tuple, events: list) -> tuple:
        state, attempts, n_events, n_illegal = now
        for _, _, nexts, tries, legal in events:
            state, attempts = nexts[state], attempts + tries[state]
            n_events, n_illegal = n_events + 1, n_illegal + (not legal)
        return state, attempts, n_events, n_illegal

    def close(self) -> None:
        pass


def task_states_of_stream(events: DataFrame, delay: str | None = None) -> DataFrame:
    """A stream of sections for the events of ``task_machine``: in each batch, one ``state`` row for each task that it
    names, and one row for every event kept apart: ``late`` (older than the watermark), ``repeated`` or ``illegal``.

    ``at`` is a timestamp; the watermark is the latest one less ``delay``. Events that it has not passed may come in any
    order and more than once; they take effect in the order of (``at``, ``event_id``). An event that is late has no effect. Without
    ``delay`` nothing is ever late, and all events of a task are kept. For the ``update`` mode; one shuffle by task.
    Events without task, id or time have no place in the order and go.
    """
    use_rocksdb(events.sparkSession)
    known = events.filter("task_id IS NOT NULL AND event_id IS NOT NULL AND at IS NOT NULL")
    if delay is not None:
        known = known.withWatermark("at", delay)
    # The time goes on as a number without watermark, so Spark does not drop late events before they are seen.
    rows = known.select(
        F.col("task_id").cast("string").alias("task_id"), F.col("event_id").cast("bigint").alias("event_id"),
        F.unix_millis("at").alias("at_millis"), function_of_event().alias("f"), is_legal().alias("legal"),
    )
    # One text per function, as lists are taken to Python number by number.
    lists = F.to_json(F.array(F.col("f.next").cast("array<bigint>"), F.col("f.tries")))
    rows = rows.select("task_id", "event_id", "at_millis", lists.alias("f"), "legal")
    machine = TaskState(TASK_STATES, START, delay is not None)
    return rows.groupBy("task_id").transformWithState(machine, OUT, "Update", "EventTime" if delay is not None else "None")


def track_tasks(events: DataFrame, path: str, delay: str | None = None, **trigger) -> StreamingQuery:
    """Write the sections of ``task_states_of_stream`` below ``path``, a folder per batch that a replay replaces."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("section").parquet(f"{path}/sections/batch_id={batch_id}")

    writer = task_states_of_stream(events.select(*EVENT_FIELDS), delay).writeStream.outputMode("update").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint_of(path)).trigger(**trigger).start()


def current_states(sections: DataFrame) -> DataFrame:
    """The newest state row of each task among all batches."""
    fields = F.struct("status", "attempts", "n_events", "n_illegal")
    latest = sections.filter("section = 'state'").groupBy("task_id").agg(F.max_by(fields, "batch_id").alias("now"))
    return latest.select("task_id", "now.*")


def latest_task_states(events: DataFrame, hashes: DataFrame, order: Column) -> DataFrame:
    """Latest event per task and the state it would restart from (ST-2).

    ``events``: task_id, status, accession_id, target_path, expected_hash; ``hashes``: path and computed_hash of the
    files as they are now. A streaming aggregate: partial results combine before the shuffle, so a task with
    very many events costs one row per input partition. Use the ``update`` or ``complete`` output mode.
    """
    fields = ["status", "accession_id", "target_path", "expected_hash"]
    latest = events.groupBy("task_id").agg(F.max_by(F.struct(*fields), order).alias("last"), F.max(order).alias("at"))
    latest = latest.select("task_id", "at", "last.*")
    # A task without target has no file; its null must not meet others in the join.
    target = F.coalesce("target_path", F.concat(F.lit("\0"), "task_id"))
    current = hashes.select(F.col("path").alias("target"), F.col("computed_hash").alias("current_hash"))
    joined = latest.withColumn("target", target).join(current, "target", "left")
    restart = recovered_status(F.col("status"), F.col("accession_id"), F.col("current_hash") == F.col("expected_hash"))
    return joined.select("task_id", "status", "accession_id", "at", restart.alias("restart_status"))
