import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeledger.llm import language_id as li
from cladeledger.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op8_language_id"](spark, sf).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_labels_of_held_out_rows_are_not_used(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    wrong = docs.withColumn("lang", F.when(learn, F.col("lang")).otherwise("xx"))
    one, two = (sorted(map(tuple, li.identify(d, learn).select("doc_id", "lang_pred", "score").collect())) for d in (docs, wrong))
    assert one == two


def counts_of(text):
    found = np.concatenate([np.empty(0, np.uint64), *li._trigrams(li._units(text))])
    return np.unique(found, return_counts=True)


def test_probabilities_sum_to_one():
    grams, counts = counts_of("the cat sat on the mat and the rat ran to the cat that sat")
    model = li.KneserNey(grams.astype(np.int64), counts)
    for context in (" t", "th", "qq", "at"):
        a, b = map(ord, context)
        total = sum(model.p3(a << 32 | b << 16 | c) for c in range(65536))
        assert total == pytest.approx(1, abs=1e-6)
    assert sum(model.p2(ord("t") << 16 | c) for c in range(65536)) == pytest.approx(1, abs=1e-6)


def test_hash_arrays_give_the_models_probabilities():
    texts = {"a": "the cat sat on the mat and more of the same", "b": "der hund und die katze auf der matte"}
    counted = {k: tuple(x.astype(np.int64) for x in counts_of(t)) for k, t in texts.items()}
    models = li.Models(counted)
    single = [li.KneserNey(*counted[k]) for k in models.languages]
    grams = np.concatenate([*li._trigrams(li._units("the katze sat zzz über qed"))])
    want = np.log([[m.p3(int(g)) for m in single] for g in grams])
    assert models.log_probabilities(grams) == pytest.approx(want, rel=1e-4)


def test_counts_over_slices_and_tasks(spark, monkeypatch):
    text = "abc def " * 2000
    whole = dict(zip(*(x.tolist() for x in counts_of(text))))
    monkeypatch.setattr(li, "_SLICE", 1000)
    docs = spark.createDataFrame([("x", text), ("x", text), ("y", "abc"), (None, "abc"), ("x", None)], "lang string, text string").repartition(4)
    got = {(r.lang, r.gram): r.n for r in li.gram_counts(docs).collect()}
    assert {g: n for (lang, g), n in got.items() if lang == "x" and g >= 0} == {g: 2 * n for g, n in whole.items()}
    assert got[("x", -1)] == 2 and got[("y", -1)] == 1


ODD = [(1, None, "en"), (2, "", "en"), (3, "123 %% 😀", "fr"), (4, "The cat and the dog sat on the mat in the house", "en"), (None, "The dog", "en"),
       (5, "Der Hund und die Katze sitzen auf der Matte im Haus", "de"), (5, "Der Hund und die Katze sitzen auf der Matte im Haus", "de"),
       (6, "the " * 50_000, None), (7, "Это русский текст без всякого сходства", None)]


def odd(spark):
    return spark.createDataFrame([(*r, "clash", 1.0) for r in ODD], "doc_id int, text string, lang string, learn string, score double")


def test_odd_rows(spark):
    got = {r.doc_id: r for r in li.identify(odd(spark), F.lit(True)).collect()}
    assert len(got) == 8
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (1, 2, 3))
    assert got[4].lang_pred == got[6].lang_pred == "en" and got[5].lang_pred == "de" and got[4].accepted
    assert not got[7].accepted
    kept = li.keep_identified(odd(spark), F.lit(True))
    assert kept.columns == odd(spark).columns
    assert {r.doc_id for r in kept.collect()} >= {4, 5} and not {r.doc_id for r in kept.collect()} & {1, 2, 3, 7}


def test_nothing_to_learn(spark):
    for docs in (odd(spark).limit(0), odd(spark).withColumn("lang", F.lit(None).cast("string"))):
        rows = li.identify(docs, F.lit(True)).collect()
        assert {(r.lang_pred, r.score) for r in rows} <= {("und", 0.0)}
        assert li.keep_identified(docs, F.lit(True)).count() == 0
    rows = li.identify(odd(spark), F.lit(None).cast("boolean")).collect()
    assert {(r.lang_pred, r.held_out) for r in rows} == {("und", False)}


def test_no_trigram_is_left_out(spark):
    """A script of many characters, with far more kinds of trigrams than a Latin one."""
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x4E00 + 400, 1500))) for _ in range(60)]
    models = li.train(spark.createDataFrame([("zh", t) for t in texts], "lang string, text string"))
    grams, counts = counts_of(texts[0])
    kinds, n = np.unique(np.concatenate([np.repeat(*counts_of(t)) for t in texts]), return_counts=True)
    assert len(kinds) > 80_000 and models.models[0].d3 == li._discount(n) != 0.5
    single = li.KneserNey(kinds.astype(np.int64), n)
    want = np.log([[single.p3(int(g))] for g in grams])
    assert models.log_probabilities(grams) == pytest.approx(want, rel=1e-4)
    assert np.isin(grams, models.models[0].grams).all()


def test_a_rare_language_is_calibrated(spark):
    """Copies of one text in a table of many labelled rows; its small model is the likeliest for unlearnt scripts."""
    common = "The cat and the dog sat on the mat in the house and heard the rain"
    rare = ["Ο σκύλος και η γάτα κάθονται στο χαλί του σπιτιού", "Η βροχή πέφτει στο σπίτι και στο δρόμο", "Το παιδί διαβάζει ένα βιβλίο στο σχολείο"]
    unlearnt = ["Это русский текст без всякого сходства", "これは日本語の文章です", "qzx wvk jjq xzz kqv"]
    for text in rare:
        rows = spark.range(40_000).selectExpr("id as doc_id", f"concat('{common} ', id) as text", "'en' as lang")
        other = [(100_000 + i, text, "el") for i in range(5)] + [(200_000 + i, t, None) for i, t in enumerate(unlearnt)]
        docs = rows.union(spark.createDataFrame(other, "doc_id long, text string, lang string")).repartition(4)
        got = {r.doc_id: r for r in li.identify(docs, F.lit(True)).filter("doc_id >= 100000").collect()}
        assert all(got[100_000 + i].accepted and got[100_000 + i].lang_pred == "el" for i in range(5))
        assert not any(got[200_000 + i].accepted for i in range(3)), got


def test_a_language_without_statistics_accepts_nothing():
    grams = {"a": tuple(x.astype(np.int64) for x in counts_of("the cat sat on the mat"))}
    none = li.Calibration({}, {}, {}, li.Models(grams).unigram)
    assert li._judge("the cat sat on the mat", li.Models(grams), none)[1] < li.ACCEPT_SCORE
