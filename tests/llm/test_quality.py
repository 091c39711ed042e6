import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeledger.llm import quality
from cladeledger.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(quality.HELD_OUT_PARTS)) == 0
    model = quality.train(docs, labels.filter(~held).union(labels.filter(held).filter("doc_id % 2 = 0")))
    got = quality.score(docs, model).join(labels.filter(held).filter("doc_id % 2 = 1"), "doc_id").collect()
    assert len(got) > 300 and np.mean([r.keep == bool(r.quality) for r in got]) >= 0.98


def test_whole_table(spark, sf):
    rows = QUERIES["op5_quality"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= x <= 1 for r in rows for x in (r.text_score, r.meta_score, r.score))


def corpus(rng, labelled, unlabelled, copies=0):
    """Documents whose words and whose source tell their quality, some labelled, one without a label in many copies."""
    rows, labels = [], []
    for i in range(labelled + unlabelled):
        good = int(rng.integers(0, 2))
        words = rng.choice(["alpha", "beta", "gamma"] if good else ["junk", "spam", "noise"], 12).tolist() + rng.choice(["the", "of", "and"], 12).tolist()
        source = f"s{int(rng.integers(0, 4)) + 4 * good}"
        rows.append((i, " ".join(words), "en", source, 100 + i % 50))
        if i < labelled:
            labels.append((i, good))
    rows += [rows[-1]] * copies
    return rows, labels


FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_training(spark, rows, labels, rounds):
    """Co-training with all rows in memory."""
    ids = sorted({r[0] for r in rows})
    by_id = {r[0]: r for r in rows}
    label = dict(labels)
    parts = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(quality.HELD_OUT_PARTS)).alias("p"))
    held = {r.doc_id for r in parts.collect() if r.p == 0 and r.doc_id in label}
    content = {i: quality.text_features(by_id[i][1]) for i in ids}
    meta = {i: quality.meta_features(by_id[i][3], by_id[i][2], by_id[i][4]) for i in ids}
    own, kept = [i for i in ids if i in label and i not in held], sorted(held)
    free = [i for i in ids if i not in label]
    stack = lambda of, which: np.stack([of[i] for i in which])
    y = lambda which, known: np.array([known[i] for i in which])
    odds = (sum(label.values()) + 1) / (len(label) + 2)
    prior = np.log(odds / (1 - odds))
    given = [{}, {}]
    for turn in range(rounds + 1):
        fitted = []
        for features, extra in ((content, given[0]), (meta, given[1])):
            more = sorted(extra)
            x = stack(features, own + more)
            view = quality.Logistic.fit(x, np.concatenate([y(own, label), y(more, extra)]) if more else y(own, label))
            fitted.append((view, quality.platt(view.logits(stack(features, kept)), y(kept, label))))
        model = quality.Model((fitted[0][0], fitted[1][0]), (fitted[0][1], fitted[1][1]), prior)
        if turn == rounds:
            return model
        chances = model.scores(stack(content, free), stack(meta, free))
        for view, chance in ((0, chances[1]), (1, chances[0])):
            # The free documents are counted by row, so a copy weighs in at the bounds once only.
            ranked = np.sort(chance)
            low, high = (ranked[max(0, int(np.ceil(p * len(ranked))) - 1)] for p in (quality.GIVEN_SHARE * (1 - odds), 1 - quality.GIVEN_SHARE * odds))
            new = {i: int(c >= max(quality.SURE, high)) for i, c in zip(free, chance) if c >= max(quality.SURE, high) or c <= min(1 - quality.SURE, low)}
            given[view] |= {i: v for i, v in new.items() if i not in given[view]}


def test_training_equals_plain_co_training(spark):
    rows, labels = corpus(np.random.default_rng(2), 200, 400)
    docs = spark.createDataFrame(rows, FIELDS).repartition(5)
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    want = plain_training(spark, rows, labels, quality.ROUNDS)
    for got_view, want_view in zip(model.views, want.views):
        assert got_view.weights == pytest.approx(want_view.weights, abs=1e-4) and got_view.bias == pytest.approx(want_view.bias, abs=1e-4)
    assert model.scales == pytest.approx(np.array(want.scales), abs=1e-3)


def test_an_id_in_forty_thousand_rows_takes_no_labels_place(spark):
    rows, labels = corpus(np.random.default_rng(3), 200, 60)
    docs, said = spark.createDataFrame(rows, FIELDS), spark.createDataFrame(labels, "doc_id long, quality int")
    copies = spark.range(40_000).select(F.lit(rows[-1][0]).alias("doc_id"), *[F.lit(v).alias(c) for c, v in zip(("text", "lang", "source"), rows[-1][1:4])], F.lit(rows[-1][4]).cast("long").alias("n_chars"))
    once, often = quality.train(docs, said), quality.train(docs.unionByName(copies), said)
    assert often.views is not None
    for a, b in zip(once.views, often.views):
        assert a.weights == pytest.approx(b.weights, abs=1e-6)
    # So does a labelled id.
    again = copies.withColumn("doc_id", F.lit(labels[0][0]).cast("long"))
    assert quality.train(docs.unionByName(again), said).views is not None


def test_views_teach_each_other(spark, monkeypatch):
    """Few labels, and words that the labelled documents hardly have: what the other view gives must help."""
    rng = np.random.default_rng(0)
    rows, truth = [], {}
    for i in range(3000):
        good = int(rng.integers(0, 2))
        truth[i] = good
        words = [f"{'g' if good else 'b'}{int(rng.integers(0, 60))}" for _ in range(2)] + [f"w{int(rng.integers(0, 200))}" for _ in range(20)]
        source = f"s{good if rng.random() < 0.97 else 1 - good}"
        rows.append((i, " ".join(words), "en", source, 100))
    docs = spark.createDataFrame(rows, FIELDS)
    labels = spark.createDataFrame([(i, truth[i]) for i in range(60)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "GIVEN_SHARE", 0.6)
    monkeypatch.setattr(quality, "SURE", 0.8)

    def accuracy(rounds):
        got = quality.score(docs, quality.train(docs, labels, rounds=rounds)).collect()
        return np.mean([(r.text_score >= 0.5) == truth[r.doc_id] for r in got if r.doc_id >= 60])

    assert accuracy(2) > accuracy(0) + 0.03


def test_calibration():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=4000) * 3
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * logits - 1)))).astype(int)
    assert quality.platt(logits, y) == pytest.approx((0.5, -1), abs=0.1)
    slope, offset = quality.platt(np.array([-9.0, 9.0]), np.array([0, 1]))
    assert np.isfinite([slope, offset]).all()


ODD = [(1, None, None, None, None), (2, "", "en", "src0", 0), (3, "plain words of some text", "en", "src1", 24), (3, "plain words of some text", "en", "src1", 24),
       (None, "no id", "xx", "", -4), (4, "\x00 \ud7ff x" * 3, "de", "s", 10**12), (5, "w " * 100_000, "de", "s", 200_000)]


def odd(spark):
    return spark.createDataFrame([(*r, 0.5) for r in ODD], "doc_id int, text string, lang string, source string, n_chars long, score double")


def test_odd_rows_and_missing_classes(spark):
    none = spark.createDataFrame([], "doc_id int, quality int, label int")
    one = spark.createDataFrame([(3, 1, 0), (5, 1, 0), (None, 0, 1), (4, None, 1)], "doc_id int, quality int, label int")
    for labels in (none, one):
        rows = quality.score(odd(spark), quality.train(odd(spark), labels)).collect()
        assert len(rows) == len(ODD) and all(r.keep for r in rows)
    assert quality.score(odd(spark).limit(0), quality.train(odd(spark).limit(0), none)).count() == 0


def test_odd_rows_with_a_model(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(odd(spark), quality.train(docs, labels)).collect()
    assert len(rows) == len(ODD) and all(np.isfinite(r.score) for r in rows)
