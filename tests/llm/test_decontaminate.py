import hashlib
import re

import pytest

from cladeledger.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item_id, text in items:
        own = words(text)
        for i in range(max(len(own) - size + 1, 1) if own else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(own[i : i + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(own), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, words string, n_hit int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, window string")
    return sorted((tuple(r)[:6] for r in decontaminate.contamination(d, b).collect()), key=str)


PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew strong black coffee"
ITEMS = [
    (1, PASSAGE), (10, PASSAGE), (2, "Short ITEM here"), (3, None), (4, " ... "), (5, "é ü 中文 naïve"), (None, "no name at all"),
    (7, "a a a a a a a a a a a a"), (8, "never seen words only"), (9, PASSAGE.upper()),
]
DOCS = [
    (1, PASSAGE), (2, f"before, {PASSAGE}! after"), (3, "the quick brown fox jumps over the lazy dog while"), (4, "short item, here short item here"),
    (5, None), (6, ""), (7, "É"), (8, "x é-ü 中文 NAïVE y"), (9, "b " + "a " * 30), (10, "a a a a a a a a a"), (11, "no name at all"),
    (12, f"{PASSAGE} " * 3), (12, f"{PASSAGE} " * 3), (None, PASSAGE), (13, "quick the brown fox jumps over the lazy dog while seven wizards"),
    (14, "short short item short item here item"), (15, ("filler words " * 3000) + PASSAGE + " tail" * 3000),
]


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ROWS, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    """Both for a benchmark that is sent to the executors and for one that is joined by shuffle."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    if not limit:
        monkeypatch.setattr(decontaminate.F, "broadcast", lambda df: pytest.fail("not to be broadcast"))
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, DOCS, []) == brute(DOCS, [])


def test_rarest_word_is_the_prefix(spark):
    docs = spark.createDataFrame([(i, "common words " * 5) for i in range(9)] + [(10, "rare common words here")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "common words rare"), (2, "absent words")], "item_id int, text string")
    got = [(r.token, r.offset, r["items"]) for r in decontaminate.prefixes(docs, items).collect()]
    assert got == [("rare", 2, ["1"])]


def test_drop_keeps_clean_rows_and_columns(spark):
    docs = spark.createDataFrame([(i, t, "own") for i, t in DOCS], "doc_id long, text string, hit_key string")
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    clean = [r for r in brute(DOCS, ITEMS) if not r[5]]
    assert sorted((str(r.doc_id), len(words(r.text))) for r in kept.collect()) == sorted((str(r[0]), r[1]) for r in clean)


def test_main_path_has_no_python(spark, sf):
    from cladeledger.llm.queries import QUERIES

    plan = QUERIES["op3_decontamination"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
