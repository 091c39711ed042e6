import math

import numpy as np
from pyspark.sql import functions as F

from cladeledger.llm import neighbours
from cladeledger.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, ids string, vector int"


def exact(rows, k, queries):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = v
    out = {}
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids.tolist()], float) if len(ids) else np.empty((0, 1))
    norms = np.linalg.norm(x, axis=1)
    for q in filter(queries, ids.tolist()):
        at = int(np.searchsorted(ids, q))
        score = np.einsum("ij,j->i", x, x[at]) / (norms * norms[at])
        order = [i for i in np.lexsort((ids, -score)).tolist() if i != at][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    assert got.keys() == want.keys()
    for q, rows in got.items():
        assert len(rows) == len(want[q])
        scores = [s for _, s in rows]
        assert scores == sorted(scores, reverse=True)
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / max(len(want[q]), 1) for q in want])


def test_recall_on_the_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = found(QUERIES["op7_neighbours"](spark, sf))
    want = exact(rows, 5, lambda i: i % 50 == 0)
    assert recall(got, want) >= 0.9
    for q, own in want.items():
        scores = dict(own)
        assert all(abs(s - scores[i]) < 1e-12 for i, s in got[q] if i in scores)


def test_recall_of_a_deep_forest(spark):
    """Random vectors, the hardest case, with one that fills a third of the rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(9000, 32)).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA).repartition(6)
    got, want = found(neighbours.nearest(df, F.col("vec_id") % 100 == 0)), exact(rows, 5, lambda i: i % 100 == 0)
    assert recall(got, want) >= 0.9
    assert [i for i, _ in got[300]] == [0, 3, 6, 9, 12]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 2.0]), (1, [1.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [0.0, 0.0]),
            (7, [2.0, 2.0]), (8, [-1.0, 0.0]), (None, [1.0, 1.0]), (200, None), (1, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA)
    got, want = found(neighbours.nearest(df, F.col("vec_id") % 100 == 0)), exact(rows, 5, lambda i: i % 100 == 0)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()} == {0: [1, 7, 100, 8], 100: [1, 7, 0, 8]}
    longer = df.union(spark.createDataFrame([(300, [1.0, 2.0, 3.0], "a", 1), (9, [], "a", 1)], SCHEMA))
    assert found(neighbours.nearest(longer, F.col("vec_id") % 100 == 0)) == got
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert neighbours.nearest(df.filter("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_vectors_of_two_lengths_are_all_answered(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(1000 + i, rng.normal(size=6).tolist()) for i in range(60)] + [(2000, [1.0])]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA).repartition(4)
    got = found(neighbours.nearest(df, F.col("vec_id") % 50 == 0))
    want = {}
    for size in (8, 6):
        want |= exact([(i, [float(np.float32(x)) for x in v]) for i, v in rows if len(v) == size], 5, lambda i: i % 50 == 0)
    assert {1000, 1050} <= got.keys() and recall(got, want) >= 0.9


def test_recall_grows_with_no_table(spark):
    """The same share of the leaves at two sizes."""
    rng = np.random.default_rng(6)
    for n in (2000, 20_000):
        rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 24)).astype(np.float32))]
        df = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA).repartition(8)
        asked = lambda i: i % 200 == 0
        assert recall(found(neighbours.nearest(df, F.col("vec_id") % 200 == 0)), exact(rows, 5, asked)) >= 0.9


def test_every_row_is_in_every_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 8))
    forest = neighbours.grow(x, len(x), trees=3)
    leaves = forest.leaves_of(x)
    assert leaves.shape == (3000, 3) and all(((leaves[:, t] // forest.leaves) == t).all() for t in range(3))
    # All leaves are reached in order of cost, the own leaf of each tree first of that tree.
    order = forest.search(x[5], 3 * forest.leaves)
    assert sorted(order) == list(range(3 * forest.leaves))
    assert set(order[:3]) == set(leaves[5].tolist())
