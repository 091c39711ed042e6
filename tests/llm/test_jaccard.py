import random
import re

import numpy as np
from pyspark.sql import functions as F

from cladeledger.llm import jaccard
from cladeledger.llm.queries import QUERIES
from cladeledger.llm.shingle_sets import grouped, shingle_sets


def plain_set(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                same = len(a & b)
                if 100 * same >= 80 * (len(a) + len(b) - same):
                    root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)) if d is not None)


def got(df):
    return sorted(tuple(r) for r in df.collect() if r.doc_id is not None)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op12_ngram_jaccard"](spark, sf)) == brute(rows)


ODD = [
    (5, None), (9, ""), (7, " \t\n"), (3, "one"), (4, "ONE"), (4, "ONE"), (12, "two words"), (None, "one"), (20, "Ünïcode ünïcode ÜNÏCODE b c"),
    (21, "x " * 9000), (22, "x x x x x"), (23, "x\x1fy z q"), (24, "a b c d"), (25, "a b c d e"), (26, "a b c d e f"), (None, "only null here"),
]


def test_odd_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, 1, "k", "x") for i, t in ODD], "doc_id int, text string, n int, kind string, key_a string")
    assert got(jaccard.near_duplicates(docs)) == brute(ODD)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def near_copies(rng, number, changed):
    base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 200))]
    out, words = [], list(base)
    for i in range(number):
        copy = list(words)
        for _ in range(rng.randrange(changed + 1)):
            copy[rng.randrange(len(copy))] = f"u{rng.randrange(10**9)}"
        if i % 5 == 0:
            words[rng.randrange(len(words))] = f"v{i}"
        out.append(" ".join(copy[: len(copy) - rng.randrange(3)]))
    return out


def test_groups_of_near_copies_and_shared_passages(spark):
    """Groups whose members are partly only reachable over others, and a passage that strangers share."""
    rng = random.Random(7)
    texts = [t for size in (2, 3, 5, 40, 120) for t in near_copies(rng, size, 4)]
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(60):
        own = " ".join(f"z{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 40)))
        texts.append(f"{passage} {own}" if i % 2 else f"{own} {passage}")
    texts += rng.choices(texts, k=30)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert got(jaccard.near_duplicates(docs)) == want


def test_rounds_of_pivots_and_all_pairs_agree(spark, monkeypatch):
    rng = random.Random(8)
    rows = list(enumerate(t for size in (2, 30) for t in near_copies(rng, size, 4)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = jaccard.screened(docs).filter("possible").groupBy("kind").agg(F.min("key_a").alias("key_a"), F.min_by("key_b", "key_a").alias("key_b"))
    lists = jaccard.materialize(jaccard.ordered(jaccard.sets_of(docs, kinds)))
    monkeypatch.setattr(jaccard, "SENT_KINDS", 0)
    assert sorted(jaccard.ordered(jaccard.sets_of(docs, kinds)).collect()) == sorted(lists.collect())
    ways = [sorted(map(tuple, jaccard.links(lists, n).collect())) for n in (0, 1.0)]
    assert ways[0] == ways[1] and ways[0]


def test_a_family_of_many_dissimilar_sets_leaves_few_pairs_open(spark):
    """Members that meet at shingles of the family but are similar to none: pairs must not grow with the family's square."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(204)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(20), 4):  # 4 of 20 places 10 apart, in one of two ways that others have too
            words[10 * at + 4] = f"u{at}_{rng.randrange(2)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = jaccard.screened(docs).filter("possible").groupBy("kind").agg(F.min("key_a").alias("key_a"), F.min_by("key_b", "key_a").alias("key_b"))
    lists = jaccard.materialize(jaccard.ordered(jaccard.sets_of(docs, kinds)))
    pairs = jaccard.materialize(jaccard._open_pairs(jaccard._placed(jaccard.cells(lists), None)), "pairs")
    similar = jaccard.verified(pairs, lists).count()
    sets = [plain_set(t) for _, t in rows]
    want = sum(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert similar == want and 0 < want < 3000
    assert pairs.count() <= 2 * want
    assert got(jaccard.near_duplicates(docs)) == brute(rows)


def test_a_bitmap_bounds_the_difference(spark):
    """Sets of every size up to many times the bits: no pair that is similar may be lost."""
    rng = random.Random(10)
    rows = []
    for size in (8, 60, 500, 4000):
        words = [f"b{size}_{i}" for i in range(size)]
        for changed in (0, size // 100, size // 60, size // 45, size // 40):
            copy = list(words)
            for at in rng.sample(range(size), changed):
                copy[at] = f"c{size}_{at}_{changed % 2}"
            rows.append((len(rows), " ".join(copy)))
    assert got(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_small_batches_only_while_it_runs(spark, monkeypatch):
    rng = random.Random(11)
    rows = list(enumerate(near_copies(rng, 20, 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, screened = spark.conf.get(name), [], jaccard.screened
    monkeypatch.setattr(jaccard, "screened", lambda d: seen.append(int(spark.conf.get(name))) or screened(d))
    monkeypatch.setattr(jaccard, "BATCH_ROWS", 2)
    assert got(jaccard.near_duplicates(docs)) == brute(rows)
    assert seen == [2] and spark.conf.get(name) == before


def test_at_the_threshold(spark):
    """Sets of 40 shingles of which 4 and 5 differ: 36 / 44 is over 0.8, 35 / 45 is not."""
    rows = []
    for i, cut in enumerate((4, 5)):
        words = [f"t{i}_{k}" for k in range(44)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join([*words[cut:], *(f"n{i}_{k}" for k in range(cut))]))]
    want = brute(rows)
    assert [c for *_, c in want] == [0, 0, 10, 11]
    assert got(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_sets_in_groups_and_pieces(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefg", k=rng.randrange(0, 60))).encode() for _ in range(80)]
    sizes = [len(plain_set(t.decode())) for t in texts]
    whole = shingle_sets(texts)
    assert whole.sizes.tolist() == sizes
    same = {}
    for t, key in zip(texts, whole.keys.tolist()):
        assert same.setdefault(frozenset(plain_set(t.decode())), key) == key
    assert len(set(same.values())) == len(same)
    for group in (1, 50, 700):
        monkeypatch.setattr("cladeledger.llm.shingle_sets.GROUP_BYTES", group)
        parts = list(grouped(texts, group))
        assert [(a, b) for a, b, _ in parts][0][0] == 0 and parts[-1][1] == len(texts)
        assert np.concatenate([s.hashes for *_, s in parts]).tolist() == whole.hashes.tolist()


def test_suffix_filter_keeps_all_similar_pairs():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 120, rng.integers(1, 100))) for _ in range(2))
        for token in np.intersect1d(a, b):
            at = int(np.searchsorted(a, token)), int(np.searchsorted(b, token))
            same = len(np.intersect1d(a, b))
            assert jaccard.similar(a, b, *at, same) and not jaccard.similar(a, b, *at, same + 1)


def test_screening_lets_all_similar_pass(spark, monkeypatch):
    rng = random.Random(11)
    texts = [t for _ in range(30) for t in near_copies(rng, 2, 1)]
    texts += [" ".join(f"z{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 200))) for _ in range(200)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id")
    groups = {}
    for d, _, c in brute(rows):
        groups.setdefault(c, []).append(d)
    linked = {d for members in groups.values() if len(members) > 1 for d in members}
    for chunk, part in ((200, 300), (10**6, 10**6)):
        monkeypatch.setattr(jaccard, "CHUNK_TOKENS", chunk)
        monkeypatch.setattr(jaccard, "PART_TOKENS", part)
        found = {r.doc_id: r.possible for r in jaccard.screened(docs).collect()}
        assert linked <= {d for d, p in found.items() if p is not False}
        assert sum(found[d] is False for d in range(60, 260)) > 190
        assert got(jaccard.near_duplicates(docs)) == brute(rows)
