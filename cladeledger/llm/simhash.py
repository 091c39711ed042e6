"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits. The vector of the segments' bit counts is its place in
a 32-dimensional grid; the Manhattan distance of two places is never more than the fingerprints' Hamming
distance. Range join: the axes fall into ``AXIS_GROUPS`` groups. Within distance ``d`` at most ``d`` groups can
differ, so two places share their coordinates on some choice of ``AXIS_GROUPS - d`` groups. Each fingerprint goes
to one grid cell per choice; inside a cell the Manhattan distance filters and the Hamming distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeledger.llm.common import LOWER, UPPER, arrow_schema, texts, unused
from cladeledger.llm.components import components
from cladeledger.workspace import materialize

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
AXIS_GROUPS = 7
HASH_SEED = 42
_SEGMENTS = 32
_SMALL_CELL = 24
_HASHES_AT_ONCE = 1 << 16

_PRINT = T.StructType().add("doc_id", "long").add("text_key", "long").add("bits", "long")
_LINK = T.StructType().add("a", "long").add("b", "long")


def fingerprint_of(text: bytes, lower: bytes) -> int:
    """Majority bits of the shingles' XXH64 as a signed 64-bit integer; 0 without words."""
    import xxhash

    words = text.translate(lower).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    size = min(SHINGLE_WORDS, len(words))
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - size + 1
    for at in range(0, n, _HASHES_AT_ONCE):
        stop = min(at + _HASHES_AT_ONCE, n)
        pairs = zip(starts[at:stop], ends[at + size - 1 : stop + size - 1])
        hashes = np.array([digest(joined[a : b - 1], HASH_SEED) for a, b in pairs], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` (a hash of the text) and ``bits`` of each row, as a written table."""
    schema = arrow_schema(_PRINT)
    lower = bytes.maketrans(UPPER.encode(), LOWER.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").cast(pa.binary())
            bits = [fingerprint_of(x.as_py(), lower) for x in column]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_key"), pa.array(bits, pa.int64())], schema=schema)

    keyed = texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return materialize(keyed.mapInArrow(run, _PRINT), "fingerprints")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def place_of(bits: Column) -> Column:
    """The segments' bit counts in unary (00, 01, 11), so Manhattan distance is a bit count of the difference."""
    low = F.lit(_signed(int("01" * _SEGMENTS, 2)))
    shifted = F.shiftrightunsigned(bits, 1)
    some = bits.bitwiseOR(shifted).bitwiseAND(low)
    both = bits.bitwiseAND(shifted).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def cell_masks(groups: int = AXIS_GROUPS, distance: int = MAX_DISTANCE) -> list[int]:
    """One mask over the unary places per choice of ``groups - distance`` groups of axes."""
    edges = [round(i * _SEGMENTS / groups) for i in range(groups + 1)]
    parts = [(1 << 2 * b) - (1 << 2 * a) for a, b in zip(edges, edges[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(parts, groups - distance)]


def _spanning(bits: np.ndarray, places: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is within reach in one cell: each member meets only those not reached yet."""
    left, out = np.arange(len(bits)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.flatnonzero(np.bitwise_count(places[left] ^ places[at]) <= MAX_DISTANCE)
            near = near[np.bitwise_count(bits[left[near]] ^ bits[at]) <= MAX_DISTANCE]
            if len(near):
                reached = left[near]
                out.append((np.full(len(reached), bits[at]), bits[reached]))
                queue.extend(reached.tolist())
                left = np.delete(left, near)
    return out


def _links_of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; a cell that goes on in the next batch is carried over."""
    schema = arrow_schema(_LINK)
    rest = None
    for batch in _with_end(batches):
        if batch is not None:
            # Unsigned, as numpy counts the bits of a negative number's absolute value.
            rows = [batch.column(n).to_numpy().view(np.uint64) for n in ("cell", "bits", "place")]
            rest = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows)]
        if rest is None or not len(rest[0]):
            continue
        changes = np.flatnonzero(rest[0][1:] != rest[0][:-1])
        stop = len(rest[0]) if batch is None else int(changes[-1]) + 1 if len(changes) else 0
        cell, bits, place = (x[:stop] for x in rest)
        rest = [x[stop:] for x in rest]
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if stop else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, stop])
        in_small = np.repeat(sizes <= _SMALL_CELL, sizes)
        for step in range(1, min(_SMALL_CELL, int(sizes.max(initial=0)))):
            same = np.flatnonzero((cell[step:] == cell[:-step]) & in_small[step:])
            same = same[np.bitwise_count(place[same] ^ place[same + step]) <= MAX_DISTANCE]
            same = same[np.bitwise_count(bits[same] ^ bits[same + step]) <= MAX_DISTANCE]
            pairs.append((bits[same], bits[same + step]))
        for i in np.flatnonzero(sizes > _SMALL_CELL):
            at = slice(starts[i], starts[i] + sizes[i])
            pairs += _spanning(bits[at], place[at])
        if pairs:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs))
            found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=schema)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(kinds: DataFrame, groups: int = AXIS_GROUPS) -> DataFrame:
    """Pairs ``a``, ``b`` of the distinct ``bits`` that join all within ``MAX_DISTANCE`` of each other.

    Small cells give every link. A large cell, such as many near copies of one text, gives links that connect
    the same fingerprints, at most one fewer than it has, and holds three integers per fingerprint in memory.
    """
    masks = [F.col("place").bitwiseAND(F.lit(m)) for m in cell_masks(groups)]
    cells = (
        kinds.select("bits", place_of(F.col("bits")).alias("place"))
        .select("bits", "place", F.posexplode(F.array(*masks)).alias("choice", "coordinates"))
        .select(F.xxhash64("choice", "coordinates").alias("cell"), "bits", "place")
    )
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links_of_cells, _LINK)


def near_duplicates(docs: DataFrame, groups: int = AXIS_GROUPS) -> DataFrame:
    """Each row's ``doc_id``, ``fingerprint`` and ``component_id``, the least ``doc_id`` it is linked to over any path.

    Null and wordless texts have fingerprint 0 and are linked with each other. Repeated rows are returned each.
    A null ``doc_id`` takes part but never names a component, unless all of its component are null. Equal
    fingerprints meet as one, so no pair of copies is ever made.
    """
    return _grouped(fingerprints(docs), groups).select("doc_id", "fingerprint", "component_id")


def _grouped(prints: DataFrame, groups: int) -> DataFrame:
    kinds = materialize(prints.groupBy("bits").agg(F.min("doc_id").alias("first_doc")), "kinds")
    reach = components(links(kinds, groups), "a", "b").withColumnsRenamed({"node": "bits", "component": "root"})
    rooted = kinds.join(reach, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    named = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = materialize(rooted.join(named, "root").select("bits", "root", "component_id"), "components")
    return prints.join(named, "bits").withColumn("fingerprint", F.lpad(F.lower(F.hex("bits")), 16, "0"))


def drop_near_duplicates(docs: DataFrame, groups: int = AXIS_GROUPS) -> DataFrame:
    """One row of each group of near-duplicates, that with the least (``doc_id``, text), with its own columns."""
    prints = fingerprints(docs)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    doc, key = unused(docs, "own_doc", "own_key")
    kept = _grouped(prints, groups).groupBy("root").agg(F.min(first).alias("kept"))
    kept = kept.select(*_plain_key(F.col("kept.doc_id"), F.col("kept.text_key"), doc, key))
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.select("*", *_plain_key(F.col("doc_id").cast("bigint"), text_key, doc, key))
    # Rows that are equal in both are one document; anything else here is unique already. The texts are dealt out
    # by the key for the join and stay where they are for this.
    return keyed.join(kept, [doc, key]).dropDuplicates([doc, key]).select(*docs.columns)


def _plain_key(doc_id: Column, text_key: Column, doc: str, key: str) -> list[Column]:
    """Two columns without nulls, as equal as id and text are."""
    return [F.coalesce(doc_id, F.lit(0).cast("bigint")).alias(doc), F.xxhash64(doc_id.isNull(), text_key).alias(key)]
