import math
from fractions import Fraction

import numpy as np
import pytest

from cladeledger.llm import whitening
from cladeledger.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, size string, n string, whitened int"


def plain(rows):
    """Exact deviations, and components of the covariance taken entry by entry in fractions."""
    x = [[math.floor(Fraction(c) * 1024) + 100_000 for c in v] for _, v in rows]
    n, size = len(x), len(x[0])
    s = [sum(v[i] for v in x) for i in range(size)]
    centred = [[Fraction(v[i]) - Fraction(s[i], n) for i in range(size)] for v in x]
    cov = np.array([[float(sum(v[i] * v[j] for v in centred) / n) for j in range(size)] for i in range(size)])
    deviation = [sum((n * v[i] - s[i]) ** 2 for i in range(size)) for v in x]
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:8]
    z = np.array([[float(e) for e in v] for v in centred])
    return deviation, values[order], z @ vectors[:, order], cov


def agree(got, rows):
    deviation, values, projected, cov = plain(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(rows) * min(8, len(rows[0][1]))
    signs = {}
    for (vec_id, _), exact, row in zip(rows, deviation, projected):
        for k, r in by_id[vec_id].items():
            assert r.n == len(rows) and int(r.deviation_digits) == exact
            assert r.deviation == (exact if exact < 1 << 63 else None)
            if values[k - 1] <= 1e-9 * max(values[0], 1e-300):
                assert r.whitened is None
                continue
            assert r.explained == pytest.approx(values[k - 1] / np.trace(cov), rel=1e-9)
            want = row[k - 1] / math.sqrt(values[k - 1])
            sign = signs.setdefault(k, 1 if (want > 0) == (r.whitened > 0) else -1) if abs(want) > 1e-6 else signs.get(k, 1)
            assert r.whitened == pytest.approx(sign * want, abs=1e-6)
    assert len({r.identity_error for r in got}) == 1


def run(spark, rows, schema="vec_id long, embedding array<double>"):
    return whitening.by_component(whitening.whiten(spark.createDataFrame(rows, schema))).collect()


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op13_embedding_whitening"](spark, sf).collect()
    agree(got, rows)
    assert got[0].identity_error < 1e-9


def test_odd_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=3).tolist()) for i in range(9)] + [(7, [0.5, -0.5, 0.0])]
    odd = [(20, None), (21, [1.0, None, 2.0]), (22, [float("nan"), 1.0, 1.0]), (23, [float("inf"), 1.0, 1.0]), (24, [])]
    got = run(spark, [(*r, "a", "b", 1) for r in good + odd], SCHEMA)
    assert {r.vec_id for r in got} == {i for i, _ in good}
    unique = [(100 + i, v) for i, (_, v) in enumerate(good)]
    agree(run(spark, unique), unique)
    assert sorted(int(r.deviation_digits) for r in got) == sorted(d for d in plain(good)[0] for _ in range(3))
    assert sum(r.vec_id is None for r in run(spark, [(None, [1.0, 2.0]), (1, [2.0, 1.0])])) == 2
    assert run(spark, []) == []


def test_without_variance(spark):
    got = run(spark, [(1, [0.25, 0.5])])
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in got] == [(None, None, 0, None)] * 2
    got = run(spark, [(1, [0.25, 0.5]), (2, [0.5, 0.5])])
    assert {r.component: r.explained for r in got} == {1: 1.0, 2: 0.0}
    assert sorted(r.whitened for r in got if r.component == 1) == pytest.approx([-1, 1])


def test_lengths_are_lists_of_their_own(spark):
    rng = np.random.default_rng(4)
    short = [(i, rng.normal(size=2).tolist()) for i in range(30)]
    long = [(100 + i, rng.normal(size=11).tolist()) for i in range(40)]
    got = run(spark, short + long)
    agree([r for r in got if r.vec_id < 100], short)
    agree([r for r in got if r.vec_id >= 100], long)


@pytest.mark.parametrize("scale", [1e4, 1e9, 1e30, 1e200, 1e305])
def test_exact_at_any_magnitude(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * scale).tolist()) for i in range(25)]
    got = run(spark, rows)
    want = plain(rows)[0] if scale < 1e100 else None
    if want:
        agree(got, rows)
    exact = [[math.floor(Fraction(c) * 1024) + 100_000 for c in v] for _, v in rows]
    sums = [sum(v[i] for v in exact) for i in range(4)]
    assert {r.vec_id: int(r.deviation_digits) for r in got} == {
        i: sum((25 * x - s) ** 2 for x, s in zip(v, sums)) for i, v in enumerate(exact)
    }
    assert got[0].identity_error < 1e-9


def test_pair_squares_recover_covariances():
    rng = np.random.default_rng(6)
    x = rng.integers(-50, 50, (200, 5))
    squares = whitening.pair_squares(x)
    for i in range(5):
        for j in range(i + 1, 5):
            assert squares[i][j - i] - squares[i][0] - squares[j][0] == 2 * (x[:, i] * x[:, j]).sum()
