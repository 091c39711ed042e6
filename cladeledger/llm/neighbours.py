"""Approximate nearest neighbours by cosine, with a forest of random-projection trees.

The planes of the trees come from a bounded sample; every row is then indexed by all trees. A query goes through
one priority queue over the nodes of all trees, nearest side first, until it has taken its share of the leaves.
Leaves and the queries that chose them meet by leaf number, and the candidates of a leaf are scored exactly. Vectors
of each length have a forest of their own, as a cosine needs two of the same length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeledger.llm.common import share
from cladeledger.workspace import materialize

TREES = 8
SAMPLE_ROWS = 16_000
SAMPLE_VALUES = 4_000_000
MAX_LEAVES = 128
MIN_LEAF_ROWS = 64
# A leaf is one task's unit; beyond MAX_LEAVES of this size the trees grow deeper.
LEAF_ROWS = 100_000
SEARCH_SHARE = 0.12
# Rows, counted once per tree, that a query meets at least.
MIN_CANDIDATES = 4_000
_BLOCK = 4_000_000


def valid(vector: Column) -> Column:
    """Neither null, nor empty, nor zero, nor holding a null or non-finite component."""
    wide = vector.cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(wide, bad) & F.exists(wide, lambda x: x != 0)


@dataclass
class Forest:
    """Per tree the planes and offsets of a full binary tree, node *i* above *2i + 1* and *2i + 2*."""

    planes: np.ndarray
    offsets: np.ndarray
    depth: int

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def leaves_of(self, units: np.ndarray) -> np.ndarray:
        """Leaf number of every row in every tree, numbered through the forest."""
        out = np.empty((len(units), len(self.planes)), np.int32)
        for tree, (planes, offsets) in enumerate(zip(self.planes, self.offsets)):
            node = np.zeros(len(units), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", units, planes[node]) > offsets[node])
            out[:, tree] = tree * self.leaves + node - (self.leaves - 1)
        return out

    def search(self, unit: np.ndarray, visits: int) -> list[int]:
        """The leaves nearest to a query: a node's cost is the squared distance to the planes it lies beyond."""
        margins = self.planes @ unit - self.offsets
        queue = [(0.0, tree, 0) for tree in range(len(self.planes))]
        found: list[int] = []
        while queue and len(found) < visits:
            cost, tree, node = heapq.heappop(queue)
            if node >= self.leaves - 1:
                found.append(tree * self.leaves + node - (self.leaves - 1))
                continue
            margin = float(margins[tree, node])
            near = 2 * node + 1 + (margin > 0)
            heapq.heappush(queue, (cost, tree, near))
            heapq.heappush(queue, (cost + margin * margin, tree, 4 * node + 3 - near))
        return found


def grow(sample: np.ndarray, rows: int, trees: int = TREES, seed: int = 1) -> Forest:
    """Trees whose planes lie between two sample points and halve the sample of their node."""
    rng = np.random.default_rng(seed)
    wanted = min(MAX_LEAVES, max(1, rows // MIN_LEAF_ROWS))
    wanted = max(wanted, -(-rows // LEAF_ROWS))
    depth = int(np.log2(max(1, min(wanted, len(sample)))))
    nodes = (1 << depth) - 1
    planes, offsets = np.zeros((trees, nodes, sample.shape[1])), np.zeros((trees, nodes))
    for tree in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(nodes):
            own = members.pop(node)
            plane, sides = np.zeros(sample.shape[1]), np.zeros(len(own))
            for _ in range(6 if len(own) > 1 else 0):
                a, b = sample[rng.choice(own, 2, replace=False)]
                tried = (a - b) / (np.linalg.norm(a - b) or 1.0)
                projected = sample[own] @ tried
                if projected.std() > sides.std():
                    plane, sides = tried, projected
            planes[tree, node], offsets[tree, node] = plane, np.median(sides) if len(own) else 0.0
            right = sides > offsets[tree, node]
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    return Forest(planes, offsets, depth)


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return chunk.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _units(matrix: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps squares of very large or small ones finite.
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of each vector length, with their unit vectors."""
    lengths = batch.column("vector").value_lengths().to_numpy()
    for size in np.unique(lengths).tolist():
        rows = batch.filter(pa.array(lengths == size)) if (lengths != size).any() else batch
        yield size, rows, _units(_matrix(rows.column("vector"), size))


def _prepared(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors with their ``keep`` smallest ids."""
    good = rows.filter(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    good = good.groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.min("embedding").alias("vector"))
    # Tasks keep the smallest ids of a vector before the shuffle, so one that fills the table stays small.
    by_id = Window.partitionBy("vector").orderBy("vec_id")
    first = good.withColumn("no", F.row_number().over(by_id)).filter(F.col("no") <= keep)
    kinds = first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return materialize(kinds, "kinds")


def _forests(kinds: DataFrame, trees: int, searched: float) -> dict[int, tuple[Forest, int, int]]:
    """Per vector length the forest, the number of its first leaf, and how many leaves a query visits."""
    counts = kinds.groupBy(F.size("vector").alias("size")).count()
    by_size = {r["size"]: r["count"] for r in counts.collect()}
    wanted = {s: max(MIN_LEAF_ROWS, min(SAMPLE_ROWS, SAMPLE_VALUES // (s * len(by_size)))) for s in by_size}
    shares = kinds.sparkSession.createDataFrame([(s, min(1.0, wanted[s] / n)) for s, n in by_size.items()], "size int, share double")
    sampled = kinds.select("vector", F.size("vector").alias("size")).join(F.broadcast(shares), "size")
    chosen = sampled.filter(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) <= F.col("share") * (1 << 30)).select("vector", "size").toArrow()
    out, first = {}, 0
    lengths = chosen["size"].to_numpy()
    for size, count in sorted(by_size.items()):
        rows = chosen.filter(pa.array(lengths == size)).slice(0, 2 * wanted[size])
        sample = _units(_matrix(rows["vector"], size)) if rows.num_rows else np.zeros((1, size))
        forest = grow(sample, count, trees)
        leaves = forest.leaves
        visits = max(1, round(searched * leaves * trees), min(leaves * trees, -(-MIN_CANDIDATES * leaves // count)))
        out[size] = forest, first, visits
        first += leaves * trees
    return out


def nearest(
    rows: DataFrame, is_query: Column, k: int = 5, searched: float = SEARCH_SHARE, trees: int = TREES
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of the ``k`` nearest found of every query.

    ``rows`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on ``vec_id``. Vectors that are null,
    empty, zero or hold a null or non-finite component take no part, nor do rows without id. A query meets the vectors
    of its own length; the driver holds one small forest per length. Repeated ids count once, with their least vector.
    Equal scores rank by the smaller id. A share ``searched`` of all leaves is visited: raise it for more recall,
    lower it for less work. An empty table gives no rows.
    """
    kinds = _prepared(rows, k + 1)
    shared = share(rows.sparkSession, _forests(kinds, trees, searched))
    kind = dict(kinds.dtypes)["vector"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = shared()
        for batch in batches:
            for size, rows, units in _by_size(batch):
                forest, first, _ = forests[size]
                leaves = forest.leaves_of(units) + first
                for tree in range(leaves.shape[1]):
                    yield pa.record_batch([pa.array(leaves[:, tree], pa.int64()), rows.column("vector"), rows.column("ids")], names=["leaf", "vector", "ids"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = shared()
        for batch in batches:
            for size, rows, units in _by_size(batch):
                forest, first, visits = forests[size]
                found = [forest.search(u, visits) for u in units]
                at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                leaves = pa.array([first + leaf for x in found for leaf in x], pa.int64())
                yield pa.record_batch([leaves, rows.column("query_id").take(at), rows.column("vector").take(at)], names=["leaf", "query_id", "vector"])

    def rerank(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            size = len(left["vector"][0])
            candidates, queries = _matrix(left["vector"], size), _matrix(right["vector"], size)
            unit, first = _units(candidates), np.array([x[0].as_py() for x in left["ids"]])
            query_ids = right["query_id"].to_numpy()
            step = max(1, _BLOCK // len(unit))
            for start in range(0, len(queries), step):
                out += _best(queries[start : start + step], query_ids[start : start + step], candidates, unit, first, k + 1)
        q, at, score = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3
        ids = left["ids"].combine_chunks().take(pa.array(at.astype(np.int64)))
        return pa.table({"query_id": pa.array(q, pa.int64()), "ids": ids, "score": pa.array(score, pa.float64())})

    # Asked from the rows, since a vector with very many equals keeps only its smallest ids as candidates.
    queries = _all_queries(rows, is_query)
    indexed = kinds.mapInArrow(index, f"leaf bigint, vector {kind}, ids array<bigint>")
    routed = queries.mapInArrow(route, f"leaf bigint, query_id bigint, vector {kind}")
    scored = indexed.groupBy("leaf").cogroup(routed.groupBy("leaf")).applyInArrow(rerank, "query_id bigint, ids array<bigint>, score double")
    pairs = scored.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id != query_id")
    each = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _all_queries(rows: DataFrame, is_query: Column) -> DataFrame:
    good = rows.filter(F.col("vec_id").isNotNull() & valid(F.col("embedding")) & is_query)
    return good.groupBy(F.col("vec_id").cast("bigint").alias("query_id")).agg(F.min("embedding").alias("vector"))


def _best(queries, query_ids, candidates, unit, first, keep: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per query the ``keep`` best rows of a leaf by (score, first id), scored on the original vectors."""
    rough = _units(queries) @ unit.T
    out = []
    lowest = np.partition(rough, -keep, axis=1)[:, -keep] if len(unit) > keep else np.full(len(queries), -np.inf)
    for row, query, query_id, least in zip(rough, queries, query_ids, lowest):
        at = np.flatnonzero(row >= least - 1e-9)
        near = candidates[at]
        score = np.einsum("ij,j->i", near, query) / (np.linalg.norm(near, axis=1) * np.linalg.norm(query))
        order = np.lexsort((first[at], -score))[:keep]
        out.append((np.full(len(order), query_id), at[order], score[order]))
    return out
