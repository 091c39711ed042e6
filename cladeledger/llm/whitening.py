"""Whitening of embeddings from an exact covariance by polarisation.

Entries become integers first. Tasks add up, for every dimension and for every sum of two dimensions, the squares of
the centred values; the variance of a sum less those of its parts is twice their covariance. All of it is integer
arithmetic, so the covariance is exact before it is rounded once for the eigenvectors.

Centring at the integer below the mean keeps the squares small: with ``z = x - floor(mean)`` and ``r`` the sum of
``z``, the sum of ``(n x - S)²`` is ``n² Σz² - n r²``. Partial sums travel in limbs of 32 bits, so no sum overflows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeledger.llm.common import share
from cladeledger.workspace import materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# Dimension sums that a task holds before it hands them on, for tables with vectors of very many lengths.
HELD_SUMS = 8_000_000
_LIMB = 32
_SUMS = "size int, i int, j int, limb int, part bigint"


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id`` as long, ``vector`` as doubles and its ``size``, of vectors that are not null or empty and hold no null or non-finite entry."""
    vector = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    good = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("vector"))
    return good.filter((F.size("vector") > 0) & ~F.exists("vector", bad)).withColumn("size", F.size("vector"))


def integers(entries: np.ndarray) -> np.ndarray:
    """``floor(SCALE * c) + SHIFT`` of doubles, as longs where squares of them surely fit, else as Python integers."""
    if not entries.size or np.abs(entries).max() < 1 << 18:
        return np.floor(entries * SCALE).astype(np.int64) + SHIFT
    # From 2^53 on every double is an integer, so scaling as an integer cannot overflow.
    exact = [int(c) * SCALE if abs(c) >= 1 << 53 else int(np.floor(c * SCALE)) for c in entries.ravel().tolist()]
    return np.array([x + SHIFT for x in exact], object).reshape(entries.shape)


def _narrow(values: np.ndarray) -> np.ndarray:
    """Longs if the values are small enough for sums of squares of a batch, else Python integers."""
    if values.dtype == object and values.size and max(map(abs, values.ravel().tolist())) < 1 << 29:
        return values.astype(np.int64)
    if values.dtype != object and values.size and len(values) * (2 * int(np.abs(values).max())) ** 2 >= 1 << 62:
        return values.astype(object)
    return values


def pair_squares(centred: np.ndarray) -> list[np.ndarray]:
    """Row *i*: the sums of ``z_i²`` and of ``(z_i + z_j)²`` for the *j* after *i*."""
    z = _narrow(centred)
    columns = np.ascontiguousarray(z.T)
    out = []
    for i in range(len(columns)):
        pairs = columns[i + 1 :] + columns[i]
        out.append(np.concatenate([(columns[i] * columns[i]).sum(keepdims=True), (pairs * pairs).sum(axis=1)]))
    return out


def _by_size(batch: pa.RecordBatch, ids: bool = False) -> Iterator[tuple]:
    """The batch's vectors as one matrix per length, with their ids if asked for."""
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes):
        rows = batch.filter(pa.array(sizes == size)) if (sizes != size).any() else batch
        matrix = rows.column("vector").flatten().to_numpy().reshape(-1, int(size))
        yield (int(size), matrix, rows.column("vec_id")) if ids else (int(size), matrix)


def _exact_sums(rows: DataFrame, prepare: Callable[[], Callable[[int, np.ndarray], list[np.ndarray]]]) -> DataFrame:
    """Sums over all rows, in limbs: each task's prepared function gives row *i* of a triangle per length, ``j`` counts from *i*."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = prepare()
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for size, matrix in _by_size(batch):
                new = [x.astype(object) for x in summed(size, matrix)]
                held[size] = [a + b for a, b in zip(held[size], new)] if size in held else new
            if sum(len(x) for rows in held.values() for x in rows) > HELD_SUMS:
                yield from _limbs(held)
                held = {}
        yield from _limbs(held)

    return rows.mapInArrow(run, _SUMS).groupBy("size", "i", "j", "limb").agg(F.sum("part").alias("part"))


def _limbs(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The lowest limbs are never negative; the last one carries the sign."""
    for size, rows in held.items():
        out: list[tuple[int, int, int, int, int]] = []
        for i, row in enumerate(rows):
            for j, value in enumerate(row.tolist(), i):
                limb = 0
                while not -(1 << _LIMB) <= value < 1 << _LIMB:
                    out.append((size, i, j, limb, value & ((1 << _LIMB) - 1)))
                    value, limb = value >> _LIMB, limb + 1
                out.append((size, i, j, limb, value))
        columns = list(zip(*out)) or [(), (), (), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["size", "i", "j", "limb", "part"])


@dataclass
class Model:
    """Of the vectors of one length: their number, sums per dimension, and the leading components as rows of ``axes``.

    Lengths are in units of ``2^shift``, above 0 only where squares would not fit a double.
    """

    n: int
    sums: list[int]
    shift: int = 0
    axes: np.ndarray | None = None
    variances: np.ndarray | None = None
    explained: np.ndarray | None = None

    @property
    def floors(self) -> np.ndarray:
        floors = [s // self.n for s in self.sums]
        small = all(abs(f) < 1 << 40 for f in floors)
        return np.array(floors, np.int64 if small else object)

    @property
    def rests(self) -> list[int]:
        """``S - n * floor(S / n)``, the sums of the centred values."""
        return [s % self.n for s in self.sums]

    def centred(self, entries: np.ndarray) -> np.ndarray:
        return integers(entries) - self.floors

    def deviations(self, centred: np.ndarray) -> list[int]:
        """Sum over dimensions of ``(n x - S)²`` of each row, exactly."""
        z, n, rests = _narrow(centred), self.n, self.rests
        fits = z.dtype != object and z.size and int(np.abs(z).max()) * max(rests) * len(rests) < 1 << 62
        cross = z @ np.array(rests, np.int64) if fits else z.astype(object) @ np.array(rests, object)
        own, rest = (z * z).sum(axis=1), sum(r * r for r in rests)
        return [n * n * int(a) - 2 * n * int(b) + rest for a, b in zip(own.tolist(), cross.tolist())]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Rows projected on the components, each over its deviation; nan where a component has no variance."""
        unit = 1 << self.shift
        offsets = np.array([(r / self.n) / unit for r in self.rests])
        z = centred.astype(np.float64) if self.shift == 0 else np.array([[v / unit for v in row] for row in centred.tolist()]).reshape(centred.shape)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (z - offsets) @ self.axes.T / np.sqrt(self.variances)
        out[:, self.variances <= 0] = np.nan
        return out


def leading(squares: list[list[int]], model: Model, components: int) -> Model:
    """The components of the covariance that ``squares``, the triangle of pair sums, gives by polarisation."""
    n, rests, size = model.n, model.rests, len(model.sums)
    own = [n * squares[i][0] - rests[i] ** 2 for i in range(size)]  # n² times the variance of a dimension
    model.shift = max(0, (max(own, default=0) // (n * n)).bit_length() // 2 - 300)
    unit = n * n << 2 * model.shift
    covariance = np.zeros((size, size))
    for i in range(size):
        covariance[i, i] = own[i] / unit
        for j in range(i + 1, size):
            both = n * squares[i][j - i] - (rests[i] + rests[j]) ** 2
            covariance[i, j] = covariance[j, i] = ((both - own[i] - own[j]) // 2) / unit
    values, vectors = np.linalg.eigh(covariance)
    keep = np.argsort(-values, kind="stable")[:components]
    values, axes = values[keep], vectors[:, keep].T
    axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] < 0, -1, 1)[:, None]
    # What rounding alone leaves of a component without variance counts as none.
    none = values <= size * np.finfo(float).eps * max(values[0], 0.0)
    model.axes, model.variances = axes, np.where(none, 0.0, values)
    total = sum(own) / unit
    model.explained = model.variances / total if total else np.full(len(values), np.nan)
    return model


def _counted(rows: DataFrame) -> dict[int, Model]:
    """Number and sums of the vectors of each length; the table has one row per length and dimension."""
    sums = _exact_sums(rows, lambda: lambda size, matrix: [x.sum(keepdims=True) for x in integers(matrix).T])
    found: dict[int, dict[int, int]] = {}
    for size, i, _, limb, part in materialize(sums, "sums").collect():
        at = found.setdefault(size, {})
        at[i] = at.get(i, 0) + (part << _LIMB * limb)
    counts = {r["size"]: r["count"] for r in rows.groupBy("size").count().collect()}
    return {size: Model(counts[size], [at[i] for i in range(size)]) for size, at in found.items()}


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """Models by vector length, from all ``usable`` rows. The driver gets sums and leading components, no square matrix."""
    models = _counted(rows)
    shared = share(rows.sparkSession, models)

    def prepare():
        models = shared()
        return lambda size, matrix: pair_squares(models[size].centred(matrix))

    squares = _exact_sums(rows, prepare)

    def solve(key, table):
        size = key[0].as_py()
        i, j = table["i"].to_numpy(), table["j"].to_numpy()
        triangle = [[0] * (size - k) for k in range(size)]
        for a, b, limb, part in zip(i.tolist(), j.tolist(), table["limb"].to_pylist(), table["part"].to_pylist()):
            triangle[a][b - a] += part << _LIMB * limb
        found = leading(triangle, shared()[size], components)
        return pa.table({
            "size": pa.array([size], pa.int32()), "shift": pa.array([found.shift], pa.int64()),
            "axes": pa.array([found.axes.ravel().tolist()], pa.list_(pa.float64())),
            "variances": pa.array([found.variances.tolist()], pa.list_(pa.float64())),
            "explained": pa.array([found.explained.tolist()], pa.list_(pa.float64())),
        })

    solved = materialize(squares, "squares").groupBy("size").applyInArrow(
        solve, "size int, shift bigint, axes array<double>, variances array<double>, explained array<double>"
    )
    for row in solved.collect():
        model = models[row["size"]]
        model.shift, model.axes = row["shift"], np.array(row["axes"]).reshape(-1, row["size"])
        model.variances, model.explained = np.array(row["variances"]), np.array(row["explained"])
    return models


def transform(rows: DataFrame, models: dict[int, Model]) -> DataFrame:
    """``vec_id``, ``size``, ``n``, ``deviation`` (digits of an exact integer), arrays ``whitened`` and ``explained`` of each row."""
    shared = share(rows.sparkSession, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared()
        for batch in batches:
            for size, matrix, ids in _by_size(batch, ids=True):
                model = models[size]
                centred = model.centred(matrix)
                count = len(matrix)
                lists = [model.whitened(centred).tolist(), [model.explained.tolist()] * count]
                clean = [[[None if np.isnan(v) else v for v in row] for row in x] for x in lists]
                yield pa.record_batch(
                    [
                        ids, pa.array([size] * count, pa.int32()), pa.array([model.n] * count, pa.int64()),
                        pa.array(list(map(str, model.deviations(centred))), pa.string()),
                        *(pa.array(x, pa.list_(pa.float64())) for x in clean),
                    ],
                    names=["vec_id", "size", "n", "deviation", "whitened", "explained"],
                )

    return rows.mapInArrow(
        run, "vec_id bigint, size int, n bigint, deviation string, whitened array<double>, explained array<double>"
    )


def identity_error(whitened: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``size`` and ``identity_error``: the largest entry of the whitened covariance less the identity, without sign.

    Components without variance do not count. Whitened values are centred already; what their means are off goes off
    the products.
    """
    at = [F.get("whitened", F.lit(k)) for k in range(components)]
    products = [F.avg(at[a] * at[b]).alias(f"p{a}_{b}") for a in range(components) for b in range(a, components)]
    means = whitened.groupBy("size").agg(*(F.avg(at[k]).alias(f"m{k}") for k in range(components)), *products)
    off = [
        F.abs(F.col(f"p{a}_{b}") - F.col(f"m{a}") * F.col(f"m{b}") - (1 if a == b else 0))
        for a in range(components) for b in range(a, components)
    ]
    return means.select("size", F.array_max(F.array(*off)).alias("identity_error"))


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector of ``rows`` (``vec_id``, ``embedding``): ``vec_id``, ``size``, ``n``, ``deviation``, arrays
    ``whitened`` and ``explained`` by component, and ``identity_error``.

    Vectors that are null or hold null or non-finite entries go; empty ones have no dimension and go too. Other
    columns do not matter, whatever their names. Vectors of each length are a fit list of their own. Repeated rows
    count and return each, as do rows without an id. ``deviation`` holds all digits at any magnitude. There are as
    many components as dimensions at most; one without variance, such as all of a single vector, has null
    ``whitened`` and nothing explained (null if no component has variance). An empty table gives no rows.
    """
    good = usable(rows)
    found = materialize(transform(good, fit(good, components)), "whitened")
    return found.join(identity_error(found, components), "size")


def by_component(whitened: DataFrame) -> DataFrame:
    """One row per vector and component, ``deviation`` as long: null where it does not fit, its digits are in ``deviation_digits``."""
    each = whitened.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "value"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").try_cast("bigint").alias("deviation"),
        F.col("value.whitened").alias("whitened"), F.col("value.explained").alias("explained"), "identity_error",
        F.col("deviation").alias("deviation_digits"),
    )
