"""First-fit-decreasing packing of sized items into bins, exact for any number of items.

A key with few items is packed in one pass. One with many items of not too many sizes is planned from its sizes: items
of one size are a run, neighbouring bins with equal room are a run, and a run of items fills a run of bins in one
step, since each bin takes what it can before the next gets any. The plan says for stretches of the sorted items
which bins they go to, so no task ever holds the items.

Keys with very many items and sizes go through waves. First fit is a stream through the bins: bins 1..K take what fits and pass the rest, in order, to bins
K+1..2K. So a block of K bins can work on one chunk of the sorted items while the next block works on
the chunk before it. Each wave runs all such (chunk, block) pairs as parallel tasks of bounded size and
gives the same bins as one pass over all items. A key is carried on only while it has items left. All waves are parts of one table, so the plan that reads them
does not grow with their number.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from cladeledger.ordering import join_pieces, split_by, split_hot, tie_break, with_last_known, with_row_number
from cladeledger.workspace import materialize, new_path

CHUNK_ROWS = 200_000
# Distinct sizes of a key that one task plans; the bins' runs are at most about twice as many.
MAX_SIZES = 20_000


def pack(
    items: DataFrame,
    capacity: int,
    size: str = "size_bp",
    item: str = "tax_id",
    keys: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
    max_sizes: int = MAX_SIZES,
) -> DataFrame:
    """Add ``bin``, numbered from 1 per key; null for items larger than ``capacity`` or without a size (WN-8, SO-1).

    Items are taken by size descending, ties by ``item``, then by a hash of all columns. Keys of over ``chunk_rows``
    items are planned by runs if they have ``max_sizes`` sizes at most, else in waves; the bins are the same.
    """
    # The items are read several times; what they come from should run only once.
    items = materialize(items, "items")
    placed = _place(items.filter(F.col(size) <= capacity), capacity, size, item, list(keys), chunk_rows, max_sizes)
    outside = items.filter(F.col(size).isNull() | (F.col(size) > capacity))
    return placed.unionByName(outside.withColumn("bin", F.lit(None).cast("bigint")))


def pack_all(
    items: DataFrame, capacity: int, size: str, item: str, keys: Sequence[str], chunk_rows: int = CHUNK_ROWS,
    max_sizes: int = MAX_SIZES,
) -> DataFrame:
    """As ``pack``, with each oversized item in a bin of its own after the others (WN-9).

    Items without a size keep a null bin.
    """
    # Read several times below; the bins should be found only once.
    packed = materialize(pack(items, capacity, size, item, keys, chunk_rows, max_sizes), "packed")
    last = packed.groupBy(*keys).agg(F.coalesce(F.max("bin"), F.lit(0)).alias("_last"))
    over = with_row_number(packed.filter(F.col(size) > capacity), keys, [F.col(item)], "_extra")
    over = over.join(last, list(keys)).withColumn("bin", F.col("_last") + F.col("_extra"))
    rest = packed.filter(F.col("bin").isNotNull() | F.col(size).isNull())
    return rest.unionByName(over.select(*packed.columns))


def _place(
    items: DataFrame, capacity: int, size: str, item: str, keys: list[str], chunk_rows: int, max_sizes: int
) -> DataFrame:
    items = items.withColumn("_tie", tie_break(items))
    if keys:
        cold, hot = split_hot(items, keys, chunk_rows)
    else:
        cold, hot = (items, None) if items.count() <= chunk_rows else (items.limit(0), items)
    fields = [f for f in items.schema.fields if f.name != "_tie"]
    schema = StructType([*fields, StructField("bin", LongType())])

    def one_pass(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values([size, item, "_tie"], ascending=[False, True, True], kind="stable")
        bins, _ = fill_bins(batch[size].to_numpy(dtype=np.int64), np.empty(0, dtype=np.int64), capacity, len(batch))
        return batch.assign(bin=[b + 1 for b in bins])[schema.names]

    placed = cold.groupBy(*keys).applyInPandas(one_pass, schema)
    if hot is None:
        return placed
    sizes = materialize(hot.groupBy(*keys, size).count(), "sizes")
    if keys:
        few, many = split_by(hot, keys, sizes.groupBy(*keys).count().filter(F.col("count") > max_sizes).drop("count"))
    else:
        few, many = (hot, None) if sizes.count() <= max_sizes else (hot.limit(0), hot)
    if many is None or keys:
        planned = sizes if many is None else split_by(sizes, keys, many.select(*keys).distinct())[0]
        placed = placed.unionByName(_place_by_runs(few, planned, capacity, size, item, keys).select(*schema.names))
    return placed if many is None else placed.unionByName(_place_in_waves(many, capacity, size, item, keys, chunk_rows))


def _place_by_runs(items: DataFrame, sizes: DataFrame, capacity: int, size: str, item: str, keys: list[str]) -> DataFrame:
    plan_fields = [*[sizes.schema[k] for k in keys], sizes.schema[size], *(StructField(n, LongType()) for n in ("_no", "_first", "_each"))]

    def plan(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(size, ascending=False)
        found = plan_runs(batch[size].to_numpy(dtype=np.int64), batch["count"].to_numpy(dtype=np.int64), capacity)
        rows = batch.iloc[np.array([r[0] for r in found], dtype=np.int64)][[*keys, size]].reset_index(drop=True)
        return rows.assign(_no=[r[1] for r in found], _first=[r[2] for r in found], _each=[r[3] for r in found])

    stretches = sizes.groupBy(*keys).applyInPandas(plan, StructType(plan_fields))
    run = [*keys, size]
    numbered = with_row_number(items, run, [F.col(item), F.col("_tie")], "_no")
    numbered = numbered.withColumns({"_no": F.col("_no") - 1, "_first": F.lit(None).cast("bigint"), "_each": F.lit(None).cast("bigint")})
    # A stretch comes right before its first item, and holds until the next one begins.
    both = numbered.withColumn("_is_item", F.lit(1)).unionByName(stretches.withColumn("_is_item", F.lit(0)), allowMissingColumns=True)
    start = F.when(F.col("_is_item") == 0, F.col("_no"))
    known = {"_first_bin": F.col("_first"), "_per_bin": F.col("_each"), "_start": start}
    filled = with_last_known(both, run, [F.col("_no"), F.col("_is_item")], known).filter("_is_item = 1")
    return filled.withColumn("bin", F.expr("_first_bin + (_no - _start) div _per_bin + 1"))


def _place_in_waves(
    items: DataFrame, capacity: int, size: str, item: str, keys: list[str], chunk_rows: int
) -> DataFrame:
    spark = items.sparkSession
    group = [*keys, "_chunk"]
    # Written by chunk, so that a wave reads only the chunk that enters it.
    chunks = materialize(_chunked(items, size, item, keys, chunk_rows), "chunks", "_chunk")
    # Never more rows than keys that have over ``chunk_rows`` items.
    ends = materialize(chunks.groupBy(*keys).agg(F.max("_chunk").alias("_last")), "ends")
    rounds = ends.agg(F.max("_last")).first()[0]
    state_fields = [chunks.schema[c] for c in group] + [StructField("_free", ArrayType(LongType()))]
    schema = StructType([*chunks.schema.fields, StructField("bin", LongType()), StructField("_free", ArrayType(LongType()))])

    def first_fit(_, batch: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        source = state if len(state) else batch
        fixed = {c: source[c].iloc[0] for c in group}
        block = wave - int(fixed["_chunk"])
        free = np.asarray(state["_free"].iloc[0]) if len(state) else np.empty(0, dtype=np.int64)
        batch = batch.sort_values([size, item, "_tie"], ascending=[False, True, True], kind="stable")
        bins, free = fill_bins(batch[size].to_numpy(dtype=np.int64), free, capacity, chunk_rows)
        integers = {c: "Int64" for c in batch.select_dtypes("integer").columns}
        rows = batch.astype(integers).assign(
            bin=pd.array([b + 1 + block * chunk_rows if b >= 0 else None for b in bins], dtype="Int64"),
            _free=None,
        )
        # The block meets the next chunk in the next wave.
        after = {**fixed, "_chunk": int(fixed["_chunk"]) + 1, "_free": [free.tolist()]}
        return pd.concat([rows, pd.DataFrame(after)])[[*batch.columns, "bin", "_free"]]

    waves = new_path(spark, "waves")
    state, waiting, wave = spark.createDataFrame([], StructType(state_fields)), None, 0
    while True:
        active = chunks.filter(F.col("_chunk") == wave)
        if waiting is not None:
            active = active.unionByName(waiting)
        step = active.groupBy(*group).cogroup(state.groupBy(*group)).applyInPandas(first_fit, schema)
        step.write.parquet(f"{waves}/_wave={wave}")
        step = spark.read.schema(schema).parquet(f"{waves}/_wave={wave}")
        waiting = step.filter("_free IS NULL AND bin IS NULL").select(*chunks.columns)
        if wave >= rounds and waiting.isEmpty():
            break
        wave += 1
        # A block's free space is of use only while its key has a chunk left to send through it.
        state = step.filter("_free IS NOT NULL")
        live = F.col("_chunk") <= F.col("_last")
        for key in keys:
            live = live & F.col(key).eqNullSafe(F.col(f"_end_{key}"))
        state = state.join(ends.withColumnsRenamed({k: f"_end_{k}" for k in keys}), live, "left_semi").select(*group, "_free")
    return spark.read.schema(schema).parquet(waves).filter("bin IS NOT NULL").select(*items.drop("_tie").columns, "bin")


def _chunked(items: DataFrame, size: str, item: str, keys: list[str], chunk_rows: int) -> DataFrame:
    """Number sorted pieces of about ``chunk_rows`` rows within each key."""
    pieces = -(-items.count() // chunk_rows)
    by = [*[F.col(k) for k in keys], F.desc(size), F.col(item), F.col("_tie")]
    ranged = materialize(
        items.repartitionByRange(pieces, *by).withColumn("_part", F.spark_partition_id()), "ranged"
    )
    window = Window.partitionBy(*(keys or [F.lit("all")])).orderBy("_part")
    numbers = (
        ranged.select(*keys, "_part").distinct().withColumn("_chunk", (F.row_number().over(window) - 1).cast("bigint"))
    )
    return join_pieces(ranged, numbers, keys).drop("_part")


def plan_runs(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """First fit of runs of equal items, sizes descending: stretches of (run, first item, first bin, items per bin).

    From its first item on, a stretch puts ``items per bin`` items into each bin from ``first bin`` on.
    """
    bins, room = np.empty(0, np.int64), np.empty(0, np.int64)
    out: list[tuple[int, int, int, int]] = []
    for run, (size, count) in enumerate(zip(sizes.tolist(), counts.tolist())):
        taken = 0
        if size <= 0:
            # What takes no room all goes to the first bin that has any, also if that is none at all.
            at = np.flatnonzero(room >= size)
            if not len(at):
                bins, room, at = np.append(bins, 1), np.append(room, capacity), [len(bins)]
            bins, room = _split(bins, room, int(at[0]), [(1, int(room[at[0]]) - size * count), (int(bins[at[0]]) - 1, int(room[at[0]]))])
            out.append((run, 0, int(bins[: at[0]].sum()), count))
            continue
        at = np.flatnonzero(room >= size)
        each = room[at] // size
        sums = np.cumsum(bins[at] * each)
        full = int(np.searchsorted(sums, count, side="right"))
        starts = np.cumsum(bins) - bins
        for k, q, before in zip(at[:full].tolist(), each[:full].tolist(), [0, *sums[:full].tolist()]):
            out.append((run, before, int(starts[k]), q))
        room[at[:full]] -= each[:full] * size
        taken = int(sums[full - 1]) if full else 0
        if taken < count and full < len(at):
            k, q, rest = int(at[full]), int(each[full]), count - taken
            out.append((run, taken, int(starts[k]), q))
            whole, more = divmod(rest, q)
            free = int(room[k])
            parts = [(whole, free - q * size), (int(more > 0), free - more * size), (int(bins[k]) - whole - (more > 0), free)]
            bins, room = _split(bins, room, k, parts)
        elif taken < count:
            q, rest = capacity // size, count - taken
            out.append((run, taken, int(bins.sum()), q))
            whole, more = divmod(rest, q)
            for number, free in ((whole, capacity - q * size), (int(more > 0), capacity - more * size)):
                if number:
                    bins, room = np.append(bins, number), np.append(room, free)
        # Neighbours with equal room are one run again.
        new = np.flatnonzero(np.r_[True, room[1:] != room[:-1]]) if len(room) else np.empty(0, np.int64)
        bins, room = (np.add.reduceat(bins, new), room[new]) if len(new) else (bins, room)
    return out


def _split(bins: np.ndarray, room: np.ndarray, at: int, parts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The runs with the one ``at`` replaced by those ``parts`` (number, room) that have a bin."""
    kept = [(n, r) for n, r in parts if n > 0]
    numbers, rooms = (np.array([p[i] for p in kept], np.int64) for i in (0, 1))
    return np.concatenate([bins[:at], numbers, bins[at + 1 :]]), np.concatenate([room[:at], rooms, room[at + 1 :]])


def fill_bins(sizes: np.ndarray, free: np.ndarray, capacity: int, limit: int) -> tuple[list[int], np.ndarray]:
    """First fit of ``sizes`` into at most ``limit`` bins; -1 for what does not fit any.

    A tree of maxima finds the first bin with room in logarithmic time.
    """
    width = 1
    while width < min(limit, len(free) + len(sizes)):
        width *= 2
    usable = min(limit, width)
    room = np.full(usable, capacity, dtype=np.int64)
    room[: len(free)] = free
    tree = np.full(2 * width, -1, dtype=np.int64)
    tree[width : width + usable] = room
    for node in range(width - 1, 0, -1):
        tree[node] = max(tree[2 * node], tree[2 * node + 1])
    maxima = tree.tolist()
    opened, bins = len(free), []
    for size in sizes.tolist():
        if maxima[1] < size:
            bins.append(-1)
            continue
        node = 1
        while node < width:
            node = 2 * node if maxima[2 * node] >= size else 2 * node + 1
        bins.append(node - width)
        opened = max(opened, node - width + 1)
        maxima[node] -= size
        while node > 1:
            node //= 2
            maxima[node] = max(maxima[2 * node], maxima[2 * node + 1])
    return bins, np.array(maxima[width : width + opened], dtype=np.int64)
