"""Best-fit packing of token pieces into fixed-size sequences by exact complements.

How many pieces of each length exist is all that decides a packing, and lengths are at most the capacity. So
the plan is made from that histogram, never from the pieces: the length of a piece picks its kind, its rank
among pieces of that length picks its place. The plan has a few runs per length, whatever the corpus size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeledger.llm.common import arrow_schema, texts
from cladeledger.llm.tokens import WordEncoder
from cladeledger.workspace import materialize

CAPACITY = 2048

PIECE = (
    T.StructType().add("doc_id", "long").add("piece", "integer").add("start", "long").add("length", "long")
    .add("ids_crc32", "long").add("part", "integer").add("place", "long")
)
PLACED = (
    T.StructType().add("doc_id", "long").add("piece", "integer").add("start", "long").add("length", "long")
    .add("ids_crc32", "long").add("sequence_id", "long").add("offset", "long")
)


class Planner:
    """Runs of equal placements: pieces ``rank`` to ``rank + n`` of one length go ``each`` at a time into the
    sequences from ``sequence`` on, the first at ``offset``."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self._left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self._left[length] = n
        self._rank = np.zeros(capacity + 1, np.int64)
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self._complements()
        self._best_fit()

    def _place(self, length: int, sequence: int, bins: int, each: int, offset: int) -> None:
        n = bins * each
        self.runs.append((length, int(self._rank[length]), n, sequence, each, offset))
        self._rank[length] += n
        self._left[length] -= n

    def _fill(self, lengths: Sequence[int]) -> None:
        """Open as many sequences holding exactly ``lengths`` as the counts allow."""
        kinds = sorted(set(lengths), reverse=True)
        bins = min(int(self._left[x]) // lengths.count(x) for x in kinds)
        offset = 0
        for kind in kinds:
            each = lengths.count(kind)
            self._place(kind, self.sequences, bins, each, offset)
            offset += kind * each
        self.sequences += bins

    def _complements(self) -> None:
        """Longest first: fill its gap exactly with one, two or three available lengths."""
        for length in range(self.capacity, 0, -1):
            while self._left[length]:
                self._left[length] -= 1  # the piece at hand is not its own complement
                found = [] if length == self.capacity else self._exact(self.capacity - length)
                self._left[length] += 1
                if found is None:
                    break
                self._fill([length, *found])

    def _exact(self, gap: int) -> list[int] | None:
        if self._left[gap]:
            return [gap]
        pair = self._pair(gap, gap)
        if pair:
            return pair
        for first in np.flatnonzero(self._left[1:gap] > 0)[::-1] + 1:
            first = int(first)
            if 3 * first < gap:
                break
            self._left[first] -= 1
            pair = self._pair(gap - first, first)
            self._left[first] += 1
            if pair:
                return [first, *pair]
        return None

    def _pair(self, total: int, largest: int) -> list[int] | None:
        """The two available lengths of sum ``total``, none over ``largest``, with the longest first one."""
        longer = np.arange(min(largest, total - 1), (total - 1) // 2, -1)
        if not len(longer):
            return None
        good = (self._left[longer] > 0) & (self._left[total - longer] > (2 * longer == total))
        if not good.any():
            return None
        first = int(longer[good.argmax()])
        return [first, total - first]

    def _best_fit(self) -> None:
        """Rest, longest first, each into the open sequence with the least room that suffices.

        Open sequences with equal room are kept as ranges of numbers, so pieces are placed many at a time.
        """
        room: dict[int, list[tuple[int, int]]] = {}
        for length in range(self.capacity, 0, -1):
            while self._left[length]:
                fits = [g for g in room if g >= length]
                gap = min(fits, default=self.capacity)
                each = gap // length
                want = int(self._left[length]) // each or 1
                each = min(each, int(self._left[length]))
                if fits:
                    first, have = room[gap].pop()
                    bins = min(want, have)
                    if have > bins:
                        room[gap].append((first + bins, have - bins))
                    if not room[gap]:
                        del room[gap]
                else:
                    first, bins = self.sequences, want
                    self.sequences += bins
                self._place(length, first, bins, each, self.capacity - gap)
                if gap > each * length:
                    room.setdefault(gap - each * length, []).append((first, bins))


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Encode whole documents, append ``end_id``, cut only what is longer than ``capacity``; a written table.

    Null text is empty, so every row gives at least the piece of its end id; repeated rows are documents of
    their own. ``part`` and ``place`` number the pieces of one length within a task.
    """
    schema = arrow_schema(PIECE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        encoder = WordEncoder.of_worker(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1).to_pylist())):
                ids = np.append(ids, end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    chunk = ids[start : start + capacity]
                    place = seen.get(len(chunk), 0)
                    seen[len(chunk)] = place + 1
                    rows.append((doc_id, piece, start, len(chunk), zlib.crc32(chunk.tobytes()), part, place))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return materialize(texts(docs).mapInArrow(cut, PIECE), "pieces")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place the pieces of ``cut_pieces``: adds ``sequence_id`` and ``offset``.

    Only the number of pieces per length, at most ``capacity`` numbers, comes to the driver. Pieces are ranked
    within their length by (part, place); a length that holds any share of all rows needs no task of its own.
    """
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    histogram = {r["length"]: r["n"] for r in ranks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(Planner(histogram, capacity).runs)
    # Runs in order of (length, first rank); a piece belongs to the last run that does not start after it.
    keys = np.array([(length << 48) + rank for length, rank, *_ in runs], np.int64)
    plan = np.array([run[1:] for run in runs], np.int64).reshape(-1, 5)
    schema = arrow_schema(PLACED)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            run = plan[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            bin_no, slot = np.divmod(rank - run[:, 0], run[:, 3])
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(run[:, 2] + bin_no), pa.array(run[:, 4] + slot * length)]
            yield pa.record_batch(columns, schema=schema)

    ranked = pieces.join(ranks.drop("n"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PLACED)
