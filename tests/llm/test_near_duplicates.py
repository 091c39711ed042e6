import random
import re

import numpy as np
import xxhash

from cladeledger.llm import components, simhash
from cladeledger.llm.queries import QUERIES


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = np.array([fingerprint(t) for _, t in rows], np.uint64)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            groups[find(i)] = min(groups.get(find(i), doc_id), doc_id)
    return sorted((d, f"{int(prints[i]):016x}", groups.get(find(i))) for i, (d, _) in enumerate(rows) if d is not None)


def got(df):
    return sorted(tuple(r) for r in df.collect() if r.doc_id is not None)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op6_simhash"](spark, sf)) == brute(rows)


ODD = [
    (5, None), (9, ""), (7, " \t\n"), (3, "one"), (4, "ONE"), (4, "ONE"), (12, "two words"), (None, "one"), (20, "Ünïcode ünïcode ÜNÏCODE b c"),
    (21, "x " * 9000), (22, "x y z q"), (23, "x\x1fy z q"),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in ODD], "doc_id int, text string, bits string, component_id int")
    assert got(simhash.near_duplicates(docs)) == brute(ODD)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_many_near_copies(spark):
    """One large group whose members differ by a few words, some only reachable over others."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows, words = [], list(base)
    for i in range(400):
        if i % 4 == 0:
            words[rng.randrange(400)] = f"v{i}"
        copy = list(words)
        copy[rng.randrange(400)] = f"u{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(60))) for i in range(100)]
    assert got(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_every_close_pair_shares_a_cell():
    rng = np.random.default_rng(2)
    masks = np.array(simhash.cell_masks(), np.int64).view(np.uint64)
    low = np.uint64(0x5555555555555555)

    def place(v):
        shifted = v >> np.uint64(1)
        return ((v | shifted) & low) | ((v & shifted & low) << np.uint64(1))

    for _ in range(3000):
        a = rng.integers(0, 1 << 63, dtype=np.uint64)
        flips = rng.choice(64, rng.integers(0, 5), replace=False)
        b = a ^ np.uint64(sum(1 << int(f) for f in flips))
        assert np.bitwise_count(place(a) ^ place(b)) <= len(flips)
        assert ((place(a) & masks) == (place(b) & masks)).any()


def test_large_cells_connect_what_small_ones_would(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 1 << 63))
    bits = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(300)}
    bits = np.array(sorted(bits), np.uint64)
    root = list(range(len(bits)))
    for a, b in simhash._spanning(bits, np.zeros(len(bits), np.uint64)):
        for x, y in zip(a, b):
            i, j = (int(np.searchsorted(bits, v)) for v in (x, y))
            assert np.bitwise_count(x ^ y) <= 4
            while root[i] != i:
                i = root[i]
            while root[j] != j:
                j = root[j]
            root[max(i, j)] = min(i, j)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, j in zip(*np.nonzero(near)):
        assert top(int(i)) == top(int(j))


def test_drop_keeps_one_row_of_each_group(spark):
    docs = spark.createDataFrame([(i, t, "own") for i, t in ODD], "doc_id int, text string, own_doc string")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id, r.text) for r in kept.collect())
    want = {c for _, _, c in brute(ODD)}
    assert len(ids) == len(want) and {i for i, _ in ids} == want
    assert {r.own_doc for r in kept.collect()} == {"own"}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (7, 7), (501, 500)], "a long, b long")
    found = {r.node: r.component for r in components.components(links, "a", "b").collect()}
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert components.components(links.limit(0), "a", "b").count() == 0
