"""Quality by co-training: a classifier on the text and one on the metadata teach each other.

Both start from a bounded sample of labelled documents. In each round both score all documents without a label, and
either one gives the surest of them, a share of the corpus, to the other as labels. A view is fitted on the labelled
documents and a bounded sample of all that it was given. Then each view's scores are calibrated on labelled documents
that were kept out of training, and all documents are scored by the sum of the calibrated log-odds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeledger.llm.common import arrow_schema, share
from cladeledger.workspace import materialize

LABELLED_SAMPLE = 8_000
# Of the documents that a view was given as labels, so many are fitted on.
GIVEN_SAMPLE = 8_000
ROUNDS = 3
# What a view gives away each round, as a share of the documents without a label, if it is as sure as that.
GIVEN_SHARE = 0.05
SURE = 0.95
HELD_OUT_PARTS = 5
KEEP_SCORE = 0.5

WORD_BUCKETS, SHAPES = 512, 8
TEXT_SIZE = WORD_BUCKETS + 129 + SHAPES
SOURCE_BUCKETS, LANG_BUCKETS, LENGTH_BINS = 64, 16, 16
META_SIZE = SOURCE_BUCKETS + LANG_BUCKETS + LENGTH_BINS + 2

_FEATURES = T.StructType().add("doc_id", "long").add("label", "integer").add("part", "integer").add("content", "binary").add("meta", "binary")
_SCORES = T.StructType().add("doc_id", "long").add("text_score", "double").add("meta_score", "double").add("score", "double")


def text_features(text: str | None) -> np.ndarray:
    """Hashed words, shares of ASCII characters, and a few shapes; all zero for null, empty and blank texts."""
    out = np.zeros(TEXT_SIZE, np.float32)
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return out
    hashes = np.fromiter(map(zlib.crc32, data.lower().split()), np.uint32, len(words))
    counts = np.log1p(np.bincount(hashes % WORD_BUCKETS, minlength=WORD_BUCKETS))
    out[:WORD_BUCKETS] = counts / np.linalg.norm(counts)
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = np.append(histogram[:128], histogram[128:].sum()) / len(data)
    out[WORD_BUCKETS : WORD_BUCKETS + 129] = np.log1p(100 * shares)
    _, repeats = np.unique(hashes, return_counts=True)
    upper, lower, digits = shares[65:91].sum(), shares[97:123].sum(), shares[48:58].sum()
    out[-SHAPES:] = (
        len(repeats) / len(words), repeats.max() / len(words), len(data) / len(words) / 10, upper, lower, digits,
        shares[33:48].sum() + shares[58:65].sum() + shares[91:97].sum() + shares[123:127].sum(), np.log10(len(words)),
    )
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed source and language and the length class; a null sets a mark of its own or nothing."""
    out = np.zeros(META_SIZE, np.float32)
    if source is not None:
        out[zlib.crc32(source.encode()) % SOURCE_BUCKETS] = 1
    if lang is not None:
        out[SOURCE_BUCKETS + zlib.crc32(lang.encode()) % LANG_BUCKETS] = 1
    if n_chars is None or n_chars < 0:
        out[-2] = 1
    else:
        out[SOURCE_BUCKETS + LANG_BUCKETS + min(LENGTH_BINS - 1, int(np.log2(n_chars + 1)))] = 1
    out[-1] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Logistic:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = ((x - mean) / scale).astype(np.float32)
        # The step is the inverse of a bound on the curvature, from the mean row size.
        rate = 1 / (0.25 * float((z * z).sum(axis=1).mean() + 1) / 4 + penalty)
        w, b, last_w, last_b = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
        for i in range(steps):
            pull = i / (i + 3)
            at_w, at_b = w + pull * (w - last_w), b + pull * (b - last_b)
            error = _sigmoid(z @ at_w.astype(np.float32) + at_b) - y
            last_w, last_b = w, b
            w = at_w - rate * (z.T @ error.astype(np.float32) / len(y) + penalty * at_w)
            b = at_b - rate * float(error.mean())
        return cls(mean, scale, w, b)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias


def platt(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log-odds; smoothed targets keep perfect separation finite."""
    good, bad = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([logits, np.ones(len(logits))], 1)
    start = np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - target * z).sum() + 5e-4 * ((w - start) ** 2).sum())

    w, now = start, loss(start)
    for _ in range(50):
        p = _sigmoid(x @ w)
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (p - target) + 1e-3 * (w - start))
        # Full Newton steps can overshoot where most chances are near 0 or 1.
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w, now = w - step, loss(w - step)
    return float(max(w[0], 0.0)), float(w[1])


@dataclass
class Model:
    """Both views with their calibration. Without two classes of labels there are no views, only the prior."""

    views: tuple[Logistic, Logistic] | None
    scales: tuple[tuple[float, float], tuple[float, float]]
    prior: float

    def scores(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.views is None:
            flat = np.full(len(content), float(_sigmoid(np.array(self.prior))))
            return flat, flat, flat
        odds = [a * view.logits(x) + b for view, (a, b), x in zip(self.views, self.scales, (content, meta))]
        return _sigmoid(odds[0]), _sigmoid(odds[1]), _sigmoid(odds[0] + odds[1] - self.prior)


def _one_class(label: np.ndarray) -> bool:
    return len(set(label.tolist())) < 2


def _log_odds(label: np.ndarray) -> float:
    good = float((label == 1).sum() + 1) / float(len(label) + 2)
    return float(np.log(good / (1 - good)))


def _fitted(views: Sequence[np.ndarray], labels: Sequence[np.ndarray], held: Sequence[np.ndarray], held_label: np.ndarray, prior: float) -> Model:
    """Both views from their rows, calibrated on the rows held out."""
    fitted = [Logistic.fit(x, y) for x, y in zip(views, labels)]
    scales = tuple(platt(view.logits(x), held_label) for view, x in zip(fitted, held))
    return Model((fitted[0], fitted[1]), scales, prior)


def _read(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and what both views read."""
    kinds = {"doc_id": "bigint", "text": "string", "source": "string", "lang": "string", "n_chars": "bigint"}
    return docs.select(*(F.col(c).cast(kind).alias(c) for c, kind in kinds.items()))


def _features(rows: DataFrame) -> pa.Table:
    """``label``, ``part`` and both views' features of a bounded number of rows, on the driver, one per document id."""
    schema = arrow_schema(_FEATURES)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [text_features(t).tobytes() for t in batch.column("text").to_pylist()]
            meta = [meta_features(*x).tobytes() for x in zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("label"), batch.column("part"), pa.array(content, pa.binary()), pa.array(meta, pa.binary())], schema=schema)

    # An id that fills the table is reduced to one row before any text moves.
    read = F.struct("text", "source", "lang", "n_chars", "label")
    once = rows.groupBy("doc_id").agg(F.min_by(read, F.xxhash64("text", "source", "lang", "n_chars")).alias("read")).select("doc_id", "read.*")
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(HELD_OUT_PARTS)).cast("int").alias("part")
    # The order of rows must not matter to the sums, so it is fixed.
    return once.select("doc_id", "label", part, "text", "source", "lang", "n_chars").mapInArrow(features, _FEATURES).orderBy("doc_id").toArrow()


def _matrices(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(
        np.frombuffer(b"".join(table[c].to_pylist()), np.float32).reshape(-1, n) for c, n in (("content", TEXT_SIZE), ("meta", META_SIZE))
    )


def _sampled(ids: DataFrame, rows: int, salt: str) -> DataFrame:
    """About ``rows`` of the distinct ids, by their hash; at most twice as many."""
    share = min(1.0, rows / max(ids.count(), 1))
    place = F.xxhash64(F.lit(salt), "doc_id")
    chosen = ids.filter(F.pmod(place, F.lit(1 << 30)) <= int(share * (1 << 30)))
    return materialize(chosen.orderBy(place, "doc_id").limit(2 * rows), "sampled")


def _given(scored: DataFrame, teacher: str, known: DataFrame | None, good: float) -> DataFrame:
    """Ids and labels of the surest documents that the other view has not been given: the best and the worst, in the
    proportion of the labels."""
    free = scored if known is None else scored.join(known.select("doc_id"), "doc_id", "left_anti")
    low, high = GIVEN_SHARE * (1 - good), 1 - GIVEN_SHARE * good
    at = scored.agg(F.percentile_approx(teacher, [low, high], 10_000)).first()[0]
    chance = F.col(teacher)
    best = chance >= max(SURE, at[1])
    chosen = free.filter(best | (chance <= min(1 - SURE, at[0])))
    return chosen.select("doc_id", F.when(best, 1).otherwise(0).alias("label"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = ROUNDS) -> Model:
    """From about ``LABELLED_SAMPLE`` labelled documents, chosen by the hash of their id, and all others without a label.

    Labelled ids of ``part`` 0 only calibrate. Repeats of an id are one document, in training and among those given,
    so an id that fills the table takes no other's place; rows without an id do not train. Without both classes in
    either part there are no views.
    """
    rows = _read(docs).filter("doc_id IS NOT NULL")
    said = labels.filter(f"doc_id IS NOT NULL AND `{label}` IN (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    said = materialize(said.agg(F.min(label).cast("int").alias("label")), "labels")
    here = materialize(said.join(rows.select("doc_id").distinct(), "doc_id", "left_semi"), "labels")
    taught = _features(rows.join(F.broadcast(_sampled(here, LABELLED_SAMPLE, "labelled")), "doc_id"))
    label_of, held = taught["label"].to_numpy(), taught["part"].to_numpy() == 0
    prior = _log_odds(label_of)
    if _one_class(label_of[held]) or _one_class(label_of[~held]):
        return Model(None, ((0.0, 0.0), (0.0, 0.0)), prior)
    good = float(1 / (1 + np.exp(-prior)))
    views = _matrices(taught)
    held_views, own_views = [x[held] for x in views], [x[~held] for x in views]
    model = _fitted(own_views, [label_of[~held]] * 2, held_views, label_of[held], prior)
    known: list[DataFrame | None] = [None, None]
    for turn in range(rounds):
        # All rows are scored where they lie, as only ids and chances need to move for what has a label to go.
        scored = _scored(rows, model).groupBy("doc_id").agg(*(F.min(c).alias(c) for c in ("text_score", "meta_score")))
        scored = materialize(scored.join(said, "doc_id", "left_anti"), "scored")
        if scored.isEmpty():
            break
        matrices, given = [], []
        for view, teacher in enumerate(("meta_score", "text_score")):
            new = materialize(_given(scored, teacher, known[view], good), "given")
            known[view] = new if known[view] is None else materialize(known[view].unionByName(new), "given")
            table = _features(rows.join(F.broadcast(_sampled(known[view], GIVEN_SAMPLE, "given")), "doc_id"))
            matrices.append(np.concatenate([own_views[view], _matrices(table)[view]]))
            given.append(np.concatenate([label_of[~held], table["label"].to_numpy()]))
        model = _fitted(matrices, given, held_views, label_of[held], prior)
    return model


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and the calibrated chances of both views and of both together, of each row."""
    shared = share(rows.sparkSession, model)
    schema = arrow_schema(_SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows = batch.slice(start, 1000)
                content = np.stack([text_features(t) for t in rows.column("text").to_pylist()])
                meta = np.stack([meta_features(*x) for x in zip(*(rows.column(c).to_pylist() for c in ("source", "lang", "n_chars")))])
                found = model.scores(content, meta)
                yield pa.record_batch([rows.column("doc_id"), *(pa.array(x, pa.float64()) for x in found)], schema=schema)

    return rows.mapInArrow(run, _SCORES)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``text_score``, ``meta_score``, ``score`` and ``keep`` of every row.

    Null and empty texts have no words and are judged on that, long ones are taken whole; nulls in metadata are features
    of their own. Repeated rows are each scored, a null ``doc_id`` stays, other columns do not matter whatever their
    names, and an empty table gives no rows. Without labels of both classes all get the prior and are kept.
    """
    keep = F.lit(True) if model.views is None else F.col("score") >= KEEP_SCORE
    return _scored(_read(docs), model).withColumn("keep", keep)
