import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from cladeledger.llm import pii
from cladeledger.llm.queries import QUERIES

SPEC = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in value.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def base(text):
    return [(k, m.start(), m.end()) for k, p in SPEC.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def digest(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(rows, docs):
    assert len(rows) == len(docs)
    texts = {}
    for doc_id, text in docs:
        texts.setdefault(doc_id, []).append(text)
    for r in rows:
        options = [base(t) for t in texts[r.doc_id]]
        found = [o for o in options if hashlib.sha256(digest(o).encode()).hexdigest() == r.base_sha256]
        assert found, (r, options)
        spans = found[0]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in spans) for x in SPEC)
        assert set(filter(None, digest(spans).split(","))) <= set(r.spans.split(","))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, kind string, start int")


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op9_personal_data"](spark, sf).collect(), docs)


ODD = [
    (1, None), (2, ""), (3, "a@b.c"), (4, "a@b.cc_x@y.z"), (5, "x@y"), (6, "1.2.3.4.5.6.7.8"), (7, "1.2.3.256 0255.0.0.1 1.2.3"),
    (8, "4111 1111 1111 1111"), (9, "4111-1111-1111-1111 4111111111111112"), (10, "4111 1111  1111 1111"), (11, "5 4111111111111111"),
    (12, "4" * 25), (13, "+1 (555) 123-4567, +12 345 678 90 12 34 56 78"), (14, "++1 2.3.4-5678901+"), (15, "+1()"), (16, "é😀 a@b.co 中 +1 555 123 45 67 😀"),
    (16, "é😀 a@b.co 中 +1 555 123 45 67 😀"), (None, "mail a@b.co"), (17, "a" * 60_000), (18, "1" * 60_000), (19, "1 " * 30_000), (20, "a." * 20_000),
    (21, "a@" + "b." * 20_000 + "c"), (22, "+1" + " 2" * 20_000), (23, "1." * 20_000), (24, "a@b.co" * 500), (25, "a@b.c 1.1.1.1\n" * 800),
    (26, "4111-1111 1111-1111-"), (27, "-4111111111111111-1"), (28, "4222222222222 6011000990139424 3530111333300000123"),
]


def test_odd_rows(spark):
    check(pii.find(frame(spark, ODD)).collect(), ODD)
    assert pii.find(frame(spark, ODD).limit(0)).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet=" -.+()@aZ059é", max_size=60), min_size=30, max_size=60))
def test_random_texts(spark, texts):
    docs = list(enumerate(texts))
    check(pii.find(frame(spark, docs)).collect(), docs)


def test_method_adds_spans_like_the_confirmed_ones(spark):
    rows = [(i, f"word call +1 (555) {100 + i}-{1000 + i} or mail user{i}@host.example.org today") for i in range(300)]
    rows += [(1000 + i, f"chapter {i} of {1990 + i} pages") for i in range(50)]
    # No base span, but it stands where mail addresses do.
    rows += [(2000, "or mail jane.doe [at] host.example now"), (2001, "order 5554443 shipped")]
    rows += [(3000 + i, f"order 555{4000 + i} shipped") for i in range(60)]
    got = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    assert all(got[i].n_phone == 1 and got[i].n_email == 1 for i in range(300))
    assert all(got[1000 + i].spans == "" for i in range(50)) and got[2001].spans == ""
    assert got[2000].spans.startswith("email_like:8:")


def test_redaction(spark):
    docs = frame(spark, [(1, "mail a@b.co, ip 1.2.3.4, é +1 555 123 45 67."), (2, "nothing"), (3, None), (4, "1.2.3.4"), (4, "1.2.3.4"),
                         (5, "+4222222222222 x")])
    docs = docs.selectExpr("*", "cast(99 as int) as n_chars", "'own' as own_doc")
    red = pii.redact(docs)
    assert red.columns == docs.columns and red.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = sorted((r.doc_id, r.text, r.n_chars) for r in red.fillna("null").collect())
    assert got[:5] == [(1, "mail [EMAIL], ip [IP], é [PHONE].", 33), (2, "nothing", 99), (3, "null", 99), (4, "[IP]", 4), (4, "[IP]", 4)]
    # A phone and a card number over the same digits become one mark.
    assert got[5] == (5, "[CARD] x", 8)
    assert pii.redact(docs.limit(0)).count() == 0


def test_boosting_tells_features_apart():
    cells = [({"f": i, "g": j}, 100, 95 if i == 1 and j == 0 else 2) for i in range(3) for j in range(2)]
    rows = [(f, good - n * 0.5, n * 0.25, n) for f, n, good in cells]
    tree = pii._grow(rows, [("f", 0), ("f", 1), ("f", 2), ("g", 0), ("g", 1)], 3)
    values = {(f["f"], f["g"]): pii._apply(tree, f) for f, _, _ in cells}
    assert values.pop((1, 0)) > 0 > max(values.values())


def test_main_path_has_no_python(spark, sf):
    plan = QUERIES["op9_personal_data"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_form_is_added_however_often_it_occurs(spark):
    """Base spans without any word in front, many bare numbers, and planted forms once, 50 and 500 times."""
    rows = [(i, f"word +1 (555) {100 + i}-{1000 + i} or user{i}@host.example.org today") for i in range(300)]
    rows += [(1000 + i, f"order 555-4{100 + i}-{1000 + i} shipped {5554000 + i}") for i in range(200)]
    for times in (1, 50, 500):
        planted = [(2000 + i, f"write to jane{i}.doe [at] host.example now, phone: 555-123-{4000 + i} or not") for i in range(times)]
        got = {r.doc_id: r for r in pii.find(frame(spark, rows + planted)).collect()}
        for i, text in planted:
            found = {text[int(a):int(b)] for _, a, b in (s.split(":") for s in got[i].spans.split(",") if s)}
            assert found == {f"jane{i - 2000}.doe [at] host.example", f"555-123-{4000 + i - 2000}"}, (times, got[i])
        assert all(got[1000 + i].spans == "" for i in range(200))
        assert all(got[i].n_phone == got[i].n_email == 1 and got[i].spans.count(",") == 1 for i in range(300))
