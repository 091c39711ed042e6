"""Language identification with interpolated Kneser-Ney character models of order three.

A text counts as its words of letters, in lower case, each between single spaces; characters are UTF-16 units.
Every training document adds to the trigram counts, which tasks pre-aggregate and Spark sums per language. A model
keeps all trigrams of its language, 12 bytes each, so it grows with the kinds of trigrams and with nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeledger.llm.common import arrow_schema, share
from cladeledger.workspace import materialize

REJECT_DEVIATIONS = 8.0
ACCEPT_SCORE = 0.4
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_SLICE = 1 << 20
_CHAR, _PAIR = np.uint64(0xFFFF), np.uint64(0xFFFFFFFF)
_EVIDENCE = 60  # characters beyond which more of them add no certainty about the language

_COUNT = T.StructType().add("lang", "string").add("gram", "long").add("n", "long")
_SCORED = (
    T.StructType().add("doc_id", "long").add("held_out", "boolean").add("lang_pred", "string").add("score", "double")
    .add("cross_entropy", "double").add("n_letters", "long").add("variance", "double")
)


def _units(text: str | None) -> np.ndarray:
    """UTF-16 units of the text's words between spaces; empty without a letter."""
    words = _LETTERS.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    return np.frombuffer(f" {' '.join(words)} ".encode("utf-16-le", "replace"), "<u2").astype(np.uint64)


def _trigrams(units: np.ndarray) -> Iterator[np.ndarray]:
    """Packed trigrams, a slice of the text at a time."""
    for start in range(0, max(len(units) - 2, 0), _SLICE):
        part = units[start : start + _SLICE + 2]
        yield part[:-2] << np.uint64(32) | part[1:-1] << np.uint64(16) | part[2:]


class _Counter:
    def __init__(self) -> None:
        self._keys, self._counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self._waiting: list[np.ndarray] = []
        self._n = 0

    def add(self, grams: np.ndarray) -> None:
        self._waiting.append(grams)
        self._n += len(grams)
        if self._n > _SLICE:
            self._merge()

    def _merge(self) -> None:
        keys, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *self._waiting]), return_counts=True)
        both = np.concatenate([self._keys, keys])
        self._keys, at = np.unique(both, return_inverse=True)
        merged = np.zeros(len(self._keys), np.int64)
        np.add.at(merged, at, np.concatenate([self._counts, counts]))
        self._counts, self._waiting, self._n = merged, [], 0

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        return self._keys.astype(np.int64), self._counts


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``n`` over whole texts; ``gram`` -1 counts the documents. Null labels and texts are skipped."""
    schema = arrow_schema(_COUNT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, _Counter] = {}
        documents: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counter = counters.setdefault(lang, _Counter())
                documents[lang] = documents.get(lang, 0) + 1
                for grams in _trigrams(_units(text)):
                    counter.add(grams)
        for lang, counter in counters.items():
            grams, counts = counter.result()
            yield pa.record_batch(
                [pa.array([lang] * (len(grams) + 1)), pa.array(np.append(grams, -1)), pa.array(np.append(counts, documents[lang]))],
                schema=schema,
            )

    usable = labelled.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    return usable.mapInArrow(count, _COUNT).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table, and whether the keys are there."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class KneserNey:
    """One language: probabilities of all orders from all its trigram counts, in sorted arrays."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        self.grams, counts = grams[order].astype(np.uint64), counts[order]
        self.pairs, lefts = np.unique(self.grams & _PAIR, return_counts=True)
        self.chars, lasts = np.unique(self.pairs & _CHAR, return_counts=True)
        self.d1, total = _discount(lasts), lasts.sum()
        self.unseen = float(self.d1 * len(self.chars) / total / 65536)
        self.seen1 = (lasts - self.d1) / total + self.unseen
        self.d2, self.first, self.weight2, self.seen2 = self._order(self.pairs, lefts, _CHAR, self.p1)
        self.d3, self.heads, self.weight3, seen = self._order(self.grams, counts, _PAIR, self.p2)
        self.seen3 = seen.astype(np.float32)

    @staticmethod
    def _order(keys: np.ndarray, counts: np.ndarray, mask: np.uint64, lower: Callable) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Discount, contexts with their back-off weights (discount x distinct followers / total), and probabilities."""
        discount = _discount(counts)
        heads, at, followers = np.unique(keys >> np.uint64(16), return_inverse=True, return_counts=True)
        total = np.bincount(at, counts)
        weight = discount * followers / total
        return discount, heads, weight, np.maximum(counts - discount, 0) / total[at] + weight[at] * lower(keys & mask)

    def p1(self, chars):
        at, known = _find(self.chars, chars)
        return np.where(known, self.seen1[at], self.unseen)

    def p2(self, pairs):
        pairs = np.asarray(pairs, np.uint64)
        at, known = _find(self.pairs, pairs)
        return self._backed_off(known, self.seen2[at], pairs, self.first, self.weight2, _CHAR, self.p1)

    def p3(self, grams):
        grams = np.asarray(grams, np.uint64)
        at, known = _find(self.grams, grams)
        return self._backed_off(known, self.seen3[at], grams, self.heads, self.weight3, _PAIR, self.p2)

    @staticmethod
    def _backed_off(known, seen, keys, heads, weights, mask: np.uint64, lower: Callable):
        if known.all():
            return seen
        at, there = _find(heads, keys >> np.uint64(16))
        return np.where(known, seen, np.where(there, weights[at], 1.0) * lower(keys & mask))


class Models:
    """The models of all languages."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        self.models = [KneserNey(*counts[x]) for x in self.languages]
        # Mean surprise of each language's own characters when only their frequencies are known.
        self.unigram = {}
        for lang, model in zip(self.languages, self.models):
            grams, n = counts[lang]
            chars, at = np.unique(grams.astype(np.uint64) & _CHAR, return_inverse=True)
            shares = np.bincount(at, n) / n.sum()
            self.unigram[lang] = -float((shares * np.log(model.p1(chars))).sum())

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        return np.log(np.stack([m.p3(grams) for m in self.models], axis=1).astype(np.float64))

    def score(self, text: str | None) -> tuple[np.ndarray, int, float]:
        """Cross-entropy per character and language, the characters, and the variance of the best one's terms."""
        units = _units(text)
        n, total, squares = 0, np.zeros(len(self.languages)), np.zeros(len(self.languages))
        for grams in _trigrams(units):
            kinds, times = np.unique(grams, return_counts=True)
            found = self.log_probabilities(kinds)
            total += times @ found
            squares += times @ (found * found)
            n += len(grams)
        if not n:
            return total, 0, 0.0
        best = int(total.argmax())
        return -total / n, n, float(squares[best] / n - (total[best] / n) ** 2)


@dataclass(frozen=True)
class Calibration:
    """Per language the usual cross-entropy, its spread between documents and the variance within them, and the
    cross-entropy of the language's text when only character frequencies are known."""

    mean: dict[str, float]
    spread: dict[str, float]
    within: dict[str, float]
    unigram: dict[str, float]

    def deviations(self, lang: str, entropy: float, n: int) -> float:
        """How far above the usual; ``REJECT_DEVIATIONS`` is reached no earlier than at the unigram level.

        Nothing is usual for a language that not even its own labelled texts were taken for, so it is infinitely far."""
        if lang not in self.mean:
            return float("inf")
        deviation = (self.spread[lang] ** 2 + self.within[lang] / max(n, 1) + 1e-9) ** 0.5
        room = (self.unigram[lang] - self.mean[lang]) / REJECT_DEVIATIONS
        return (entropy - self.mean[lang]) / max(deviation, room)


def train(labelled: DataFrame) -> Models | None:
    """Models of the labels in ``lang``; None when no labelled document has a letter."""
    counts = materialize(gram_counts(labelled), "grams").filter("gram >= 0")
    found = {}
    for (lang,) in counts.select("lang").distinct().collect():
        rows = counts.filter(F.col("lang") == lang).select("gram", "n").toArrow()
        found[lang] = rows["gram"].to_numpy(), rows["n"].to_numpy()
    return Models(found) if found else None


def _score(docs: DataFrame, models: Models | None, calibration: Calibration | None) -> DataFrame:
    shared = share(docs.sparkSession, (models, calibration))
    schema = arrow_schema(_SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, calibration = shared()
        for batch in batches:
            rows = [_judge(text, models, calibration) for text in batch.column("text").to_pylist()]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[2:])] if rows else []
            if rows:
                yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), *columns], schema=schema)

    return docs.mapInArrow(run, _SCORED)


def _judge(text: str | None, models: Models | None, calibration: Calibration | None) -> tuple:
    entropy, n, variance = models.score(text) if models else (np.zeros(0), 0, 0.0)
    if not n:
        return UNDETERMINED, 0.0, None, 0, None
    best = int(entropy.argmin())
    lang = models.languages[best]
    certain = 1 / float(np.exp((entropy[best] - entropy) * min(n, _EVIDENCE)).sum())
    if calibration:
        far = calibration.deviations(lang, float(entropy[best]), n) - REJECT_DEVIATIONS
        certain /= 1 + float(np.exp(np.clip(far, -50, 50)))
    return lang, certain, float(entropy[best]), n, variance


def split(docs: DataFrame, learn: Column) -> DataFrame:
    """The columns used here, with ``held_out``; ``learn`` tells the rows whose labels may be used."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"),
        F.coalesce(~learn, F.lit(False)).alias("held_out"), F.coalesce(learn, F.lit(False)).alias("learn"),
    )


def identify(docs: DataFrame, learn: Column) -> DataFrame:
    """Each row's ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``accepted`` and ``cross_entropy``.

    Only text, and the label of rows where ``learn`` holds, are used. Null texts and texts without a letter are
    ``und`` with score 0; so are all rows if nothing can be learnt. ``score`` is the certainty among the
    languages times the calibrated chance that the text is one of them; ``accepted`` is a score of
    ``ACCEPT_SCORE`` or more. A null ``learn`` teaches nothing. All labelled
    documents calibrate.
    """
    rows = split(docs, learn)
    labelled = rows.filter("learn AND lang IS NOT NULL AND text IS NOT NULL")
    models = train(labelled)
    calibration = _calibrate(labelled, models) if models else None
    scored = _score(rows.select("doc_id", "text", "held_out"), models, calibration)
    accepted = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= ACCEPT_SCORE)
    return scored.select("doc_id", "held_out", "lang_pred", "score", accepted.alias("accepted"), "cross_entropy")


def keep_identified(docs: DataFrame, learn: Column) -> DataFrame:
    """The rows of ``docs`` that ``identify`` accepts, with their own columns. Nothing is joined, so repeated rows
    and null ids need no care."""
    labelled = split(docs, learn).filter("learn AND lang IS NOT NULL AND text IS NOT NULL")
    models = train(labelled)
    shared = share(docs.sparkSession, (models, _calibrate(labelled, models) if models else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared()
        for batch in batches:
            judged = (_judge(text, *known) for text in batch.column("text").to_pylist())
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= ACCEPT_SCORE for lang, score, *_ in judged], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _calibrate(labelled: DataFrame, models: Models) -> Calibration:
    """From all labelled rows; only sums per language leave the tasks."""
    scored = _score(labelled.select("doc_id", "text", "held_out"), models, None).filter("n_letters > 0")
    weight = F.sum("n_letters")
    stats = scored.groupBy("lang_pred").agg(
        (F.sum(F.col("cross_entropy") * F.col("n_letters")) / weight).alias("mean"),
        F.coalesce(F.stddev_pop(F.when(F.col("n_letters") >= 300, F.col("cross_entropy"))), F.lit(0.0)).alias("spread"),
        (F.sum(F.col("variance") * F.col("n_letters")) / weight).alias("within"),
    ).collect()
    usual = ({r["lang_pred"]: float(r[c]) for r in stats} for c in ("mean", "spread", "within"))
    return Calibration(*usual, unigram=models.unigram)
