"""Repair tasks as a state machine driven by events (ST-2).

An event is a function over the task states: where each state leads, and how many attempts that adds. Functions
compose, and composition is associative, so the events of a task are composed in runs of bounded length, the runs'
functions again, and so on. A task with very many events thus spreads over many tasks of the cluster.

Events have ``task_id``, ``event_id``, ``at``, ``kind`` and ``status``. ``update`` sets ``status``; ``recover`` moves an
interrupted task back, needs ``accession_id`` and, for a fixed one, ``fix_holds``; ``retry`` queues a failed task again
and adds an attempt. Any other kind or status is illegal and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeledger.fixed_values import TASK_STATES
from cladeledger.functions.text import literal_array
from cladeledger.operators.dedup import first_wins
from cladeledger.operators.repair import recovered_status, requeued
from cladeledger.ordering import with_row_number
from cladeledger.workspace import materialize

START = "PENDING"
RUN = 1024
EVENT_FIELDS = ("task_id", "event_id", "at", "kind", "status", "accession_id", "fix_holds")


def is_legal() -> Column:
    return F.coalesce(F.when(F.col("kind") == "update", F.col("status").isin(TASK_STATES)).otherwise(F.col("kind").isin("recover", "retry")), F.lit(False))


def function_of_event() -> Column:
    """Struct of ``next``, the number of the state that each state leads to, and ``tries``, the attempts this adds."""
    number = {s: i for i, s in enumerate(TASK_STATES)}
    targets, tries = [], []
    for state, i in number.items():
        after = F.when(~is_legal(), state).when(F.col("kind") == "update", F.col("status"))
        after = after.when(F.col("kind") == "retry", requeued(F.lit(state)))
        after = after.otherwise(recovered_status(F.lit(state), F.col("accession_id"), F.col("fix_holds")))
        targets.append((F.array_position(literal_array(TASK_STATES), after) - 1).cast("int"))
        again = is_legal() & (F.col("kind") == "retry") & (requeued(F.lit(state)) != state)
        tries.append(F.when(again, 1).otherwise(0).cast("bigint"))
    return F.struct(F.array(*targets).alias("next"), F.array(*tries).alias("tries"))


def _composed(functions: Column) -> Column:
    """One function for a list of them, applied in order."""
    same = F.struct(
        F.array(*[F.lit(i) for i in range(len(TASK_STATES))]).alias("next"),
        F.array(*[F.lit(0).cast("bigint") for _ in TASK_STATES]).alias("tries"),
    )

    def then(first: Column, second: Column) -> Column:
        return F.struct(
            F.transform(first["next"], lambda s: F.get(second["next"], s)).alias("next"),
            F.zip_with(first["tries"], first["next"], lambda n, s: n + F.get(second["tries"], s)).alias("tries"),
        )

    return F.aggregate(functions, same, lambda done, f: then(done, f))


def final_states(events: DataFrame, run: int = RUN) -> DataFrame:
    """``task_id``, ``status``, ``attempts``, ``n_events`` and ``n_illegal`` after all events, in the order of (``at``, ``event_id``).

    An ``event_id`` that comes again for a task, such as one delivered twice, counts once, at its first time.
    """
    once = first_wins(events.select(*EVENT_FIELDS), ["task_id", "event_id"], F.struct("at", "kind", "status"))
    numbered = with_row_number(once, ["task_id"], [F.col("at"), F.col("event_id")], "no")
    illegal = F.when(is_legal(), 0).otherwise(1).cast("bigint")
    runs = numbered.select(
        "task_id", (F.col("no") - 1).alias("no"), function_of_event().alias("f"), F.lit(1).cast("bigint").alias("n_events"), illegal.alias("n_illegal")
    )
    longest = None
    while longest is None or longest > 0:
        # Each list has ``run`` members at most, however many events a task has.
        lists = runs.groupBy("task_id", F.expr(f"no div {run}").alias("no")).agg(
            F.sort_array(F.collect_list(F.struct("no", "f"))).alias("fs"), F.sum("n_events").alias("n_events"), F.sum("n_illegal").alias("n_illegal")
        )
        composed = _composed(F.transform("fs", lambda x: x["f"]))
        runs = materialize(lists.select("task_id", "no", composed.alias("f"), "n_events", "n_illegal"), "runs")
        longest = runs.agg(F.max("no")).first()[0] or 0
    start = TASK_STATES.index(START)
    status = F.get(literal_array(TASK_STATES), F.get("f.next", F.lit(start)))
    return runs.select("task_id", status.alias("status"), F.get("f.tries", F.lit(start)).alias("attempts"), "n_events", "n_illegal")
