"""Personal data by boosted span candidates, in DataFrame functions only.

Generators of high recall propose overlapping spans: the four base kinds and wider forms of them. Every candidate
gets a few discrete features of its format and its surroundings. Candidates of all documents are counted by
feature combination and by what is known of them, which gives a table whose size is bounded by the number of
combinations. Known as personal data are spans that the exact rules confirm, what overlaps them, and wider forms
with a mark of their own: a word in front that names them, or an address written out. Boosted trees are fitted to
that table, in which every form weighs the same however often it occurs, become a SQL expression, and score every
candidate; the threshold is the lowest score above which enough counted candidates are known ones.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeledger.llm.common import unused, with_key
from cladeledger.workspace import materialize

BASE_KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
ROUNDS = 24
RATE = 0.4
# Each combination of features weighs this much, and a leaf holds at least this share of them all.
FORM_WEIGHT = 20
LEAF_SHARE = 0.002

# A run of name characters or digits can only match from its first one, unless a match ended inside it; saying so
# keeps long runs linear. Possessive loops keep Java from recursing. Neither changes what is found.
_NUMBER = r"(?:(?<![0-9])|\G)[0-9]++"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _NUMBER + r"\.[0-9]++\.[0-9]++\.[0-9]++",
    # The whole run of digits with single separators, if it has 13 to 19 of them.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "email_like": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?: ?[\[(]at[\])] ?| ?@ ?)[a-z0-9-]{1,63}+(?: ?[\[(]dot[\])] ?|\.)[a-z]{2,12}",
    "number_like": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ()./-]{0,2}[0-9]){6,24}(?![0-9A-Za-z])",
}
KINDS = tuple(PATTERNS)
_GUARDS = {"email": "@", "email_like": None, "phone": "+"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_NUMBER_HINTS = r"(?i)\b(?:tel|phone|call|fax|mobile|contact|card|visa|iban|account)\W{0,4}$"
_OTHER_HINTS = r"(?i)\b(?:mail|ip|host|server|address)\W{0,4}$"
_BEFORE, _AFTER = 24, 4
_KEY = ["doc_id", "text_key"]


def _found(kind: str) -> Column:
    """Matches of one kind with the gap before each and the text on both sides; empty without a match."""
    pattern = F.lit(PATTERNS[kind])
    matches = F.regexp_extract_all("text", pattern, 0)
    gaps = F.transform(
        F.split("text", PATTERNS[kind], -1),
        lambda gap: F.struct(
            F.char_length(gap).alias("size"), F.right(gap, F.lit(_BEFORE)).alias("before"), F.left(gap, F.lit(_AFTER)).alias("after")
        ),
    )
    zipped = F.zip_with(
        F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("value"), g["size"].alias("gap"), g["before"].alias("before"))),
        F.slice(gaps, 2, F.size(gaps) - 1),
        lambda m, g: F.struct(F.lit(kind).alias("kind"), m["value"].alias("value"), m["gap"].alias("gap"), m["before"].alias("before"), g["after"].alias("after")),
    )
    # zip_with pads to the longer side: the last gap has no match.
    zipped = F.slice(zipped, 1, F.size(gaps) - 1)
    guard = _GUARDS.get(kind, "digit")
    may = F.lit(True) if guard is None else F.col("text").rlike("[0-9]") if guard == "digit" else F.contains("text", F.lit(guard))
    return F.when(may & F.col("text").rlike(PATTERNS[kind]), zipped)


def _luhn(digits: Column) -> Column:
    """Holds for 13 to 19 digits with a right check digit; zeros in front change nothing."""
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(20):
        digit = F.substring(padded, i + 1, 1).cast("int")
        if i % 2 == 0:
            digit = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        total = total + digit
    return total % 10 == 0


def _confirmed() -> Column:
    digits = F.length(F.regexp_replace("value", "[^0-9]", ""))
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", F.col("value").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(F.col("kind") == "card", _luhn(F.regexp_replace("value", "[ -]", "")))
        .when(F.col("kind") == "phone", digits.between(9, 15))
        .otherwise(False)
    )


def _side(column: str, end: str) -> Column:
    char = F.right(F.col(column), F.lit(1)) if end == "last" else F.left(F.col(column), F.lit(1))
    return (
        F.when(char == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike(r"\p{L}"), 2).when(char.rlike("[0-9]"), 3).otherwise(4)
    )


def _features() -> dict[str, Column]:
    """Small integers only, so their combinations are bounded: 6 x 6 x 2 x 2 x 5 x 5 x 5 x 3 x 3 x 2."""
    digits = F.length(F.regexp_replace("value", "[^0-9]", ""))
    separators = F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace("value", "[^ ./-]", ""), ""))), "")
    tail = F.length(F.regexp_extract("value", "([0-9]*)$", 1))
    return {
        "f_kind": reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), enumerate(KINDS), F),
        "f_digits": F.when(digits == 0, 0).when(digits < 9, 1).when(digits < 13, 2).when(digits < 16, 3).when(digits < 20, 4).otherwise(5),
        "f_plus": F.contains("value", F.lit("+")).cast("int"),
        "f_bracket": F.contains("value", F.lit("(")).cast("int"),
        "f_separators": F.when(separators == "", 0).when(separators == " ", 1).when(separators == "-", 2).when(separators == ".", 3).otherwise(4),
        "f_before": _side("before", "last"),
        "f_after": _side("after", "first"),
        "f_hint": F.when(F.col("before").rlike(_NUMBER_HINTS), 1).when(F.col("before").rlike(_OTHER_HINTS), 2).otherwise(0),
        "f_tail": F.when(tail == 4, 0).when(tail > 4, 1).otherwise(2),
        "f_written": F.col("value").rlike(r"(?i)[\[(]at[\])]").cast("int"),
    }


def _marked() -> Column:
    """Wider forms that say themselves what they are; by features only, so that a form is marked always or never.

    Numbers of up to 15 digits, as the longest telephone numbers, after a word that names them; addresses that are
    written out or named.
    """
    kind, hint = F.col("f_kind"), F.col("f_hint")
    number = (kind == KINDS.index("number_like")) & (hint == 1) & F.col("f_digits").between(1, 3)
    return number | (kind == KINDS.index("email_like")) & ((F.col("f_written") == 1) | (hint > 0))


def candidates(docs: DataFrame) -> DataFrame:
    """All proposed spans with ``start`` and ``end`` in code points, what the rules say, and features; a written table.

    ``confirmed``: a base span that holds. ``overlaps``: touches a confirmed span of the same row.
    """
    keyed = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"),
    )
    each = keyed.select("_row", *_KEY, F.explode(F.array(*[_found(k) for k in KINDS])).alias("spans"))
    rows = each.select("_row", *_KEY, F.posexplode("spans").alias("_no", "span")).select("_row", *_KEY, "_no", "span.*")
    so_far = Window.partitionBy("_row", "kind").orderBy("_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("value")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(so_far)).withColumn("start", F.col("end") - size)
    rows = rows.withColumn("confirmed", _confirmed())
    in_row = Window.partitionBy("_row").orderBy("start")
    reach = F.max(F.when(F.col("confirmed"), F.col("end"))).over(in_row.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    onward = F.min(F.when(F.col("confirmed"), F.col("start"))).over(in_row.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    overlaps = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(onward < F.col("end"), F.lit(False))
    out = rows.withColumn("overlaps", overlaps).withColumns(_features())
    return materialize(out.drop("_no", "gap", "before", "after", "value"), "candidates")


# Boosting ------------------------------------------------------------------------------------------

Test = tuple[str, int]


def _gain(rows: list[tuple], test: Test) -> tuple[float, list[tuple], list[tuple]]:
    yes = [r for r in rows if r[0][test[0]] == test[1]]
    no = [r for r in rows if r[0][test[0]] != test[1]]
    return _value(yes) + _value(no), yes, no


def _value(rows: list[tuple]) -> float:
    """Newton step objective of rows (features, gradient, curvature, candidates)."""
    gradient, curvature = sum(r[1] for r in rows), sum(r[2] for r in rows)
    return gradient * gradient / (curvature + 1.0)


def _step(rows: list[tuple]) -> float:
    return RATE * sum(r[1] for r in rows) / (sum(r[2] for r in rows) + 1.0)


def _grow(rows: list[tuple], tests: list[Test], depth: int, least: float = 0.0):
    """A tree is a number or (test, tree if it holds, tree if not); ``least`` is what a leaf must hold."""
    if depth == 0 or len(rows) < 2:
        return _step(rows)
    splits = ((*_gain(rows, t), t) for t in tests)
    large = (s for s in splits if s[1] and s[2] and min(sum(r[3] for r in s[1]), sum(r[3] for r in s[2])) >= least)
    best = max(large, key=lambda s: s[0], default=None)
    if best is None or best[0] <= _value(rows) + 1e-6:
        return _step(rows)
    return best[3], _grow(best[1], tests, depth - 1, least), _grow(best[2], tests, depth - 1, least)


def _apply(tree, features: dict[str, int]) -> float:
    while isinstance(tree, tuple):
        tree = tree[1] if features[tree[0][0]] == tree[0][1] else tree[2]
    return tree


def _as_column(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    (name, value), yes, no = tree
    return F.when(F.col(name) == value, _as_column(yes)).otherwise(_as_column(no))


def fit(spans: DataFrame) -> tuple[Column, float]:
    """Score column and calibrated threshold, from the counts of all candidates.

    A candidate is known if the exact rules hold for it or for a span that it overlaps, or if it is marked. Without
    candidates, or if no score reaches ``PRECISION``, the threshold is infinite and nothing is added.
    """
    names = list(_features())
    said = (F.col("confirmed") | F.col("overlaps") | _marked()).cast("int")
    table = spans.groupBy(*names).agg(F.count("*").alias("n"), F.sum(said).alias("good")).orderBy(*names).collect()
    cells = [({c: r[c] for c in names}, r["n"], r["good"]) for r in table]
    tests = sorted({(c, f[c]) for f, _, _ in cells for c in names})
    scores, trees = [0.0] * len(cells), []
    for _ in range(ROUNDS if cells else 0):
        rows = []
        for (features, n, good), score in zip(cells, scores):
            chance = 1 / (1 + math.exp(-score))
            curvature = FORM_WEIGHT * chance * (1 - chance)
            rows.append((features, FORM_WEIGHT * (good / n - chance), curvature, FORM_WEIGHT))
        trees.append(_grow(rows, tests, 3, LEAF_SHARE * FORM_WEIGHT * len(cells)))
        scores = [max(-30.0, min(30.0, s + _apply(trees[-1], f))) for s, (f, _, _) in zip(scores, cells)]
    threshold, all_n, all_good = math.inf, 0, 0
    for score, (_, n, good) in sorted(zip(scores, cells), key=lambda x: -x[0]):
        all_n, all_good = all_n + n, all_good + good
        if all_good >= PRECISION * all_n and score > 0:
            threshold = score
    return reduce(lambda a, b: a + b, map(_as_column, trees), F.lit(0.0)), threshold


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, ``kind``, ``start``, ``end``, ``base`` of every span found; one row each.

    All confirmed base spans, and every other candidate at or above the threshold that touches none of them.
    """
    proposed = candidates(docs)
    score, threshold = fit(proposed)
    added = F.lit(False) if math.isinf(threshold) else (score >= threshold - 1e-9) & ~F.col("overlaps")
    chosen = proposed.filter(F.col("confirmed") | added)
    return chosen.select(*_KEY, "kind", "start", "end", F.col("confirmed").alias("base")).distinct()


def _place(kind: Column) -> Column:
    return F.array_position(F.lit(list(KINDS)), kind)


def _joined(only_base: bool) -> Column:
    entry = F.struct(_place(F.col("kind")).alias("place"), "start", "end", "kind")
    gathered = F.collect_list(F.when(F.col("base"), entry) if only_base else entry)
    return F.array_join(F.transform(F.sort_array(gathered), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256`` and ``spans``.

    A null text is empty and has no spans. Repeated rows are each returned alike. Spans of one document stand in
    one string, by kind and start.
    """
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE_KINDS]
    found = spans(docs).groupBy(*_KEY).agg(*counts, _joined(True).alias("base"), _joined(False).alias("spans"))
    found = found.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    numbers = [F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    base = F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256")
    return joined.select("doc_id", *numbers, base, F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become one.

    Rows without a span stay as they are. Where a text changes and there is an ``n_chars``, it is set anew.
    """
    found = spans(docs)
    in_text = Window.partitionBy(*_KEY).orderBy("start", "end")
    reach = F.max("end").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    numbered = found.withColumn("new", (F.coalesce(reach, F.lit(-1)) <= F.col("start")).cast("int"))
    numbered = numbered.withColumn("island", F.sum("new").over(in_text.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = numbered.groupBy(*_KEY, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("kind").alias("kind"))
    doc, key, cut_doc, cut_key, cut = unused(docs, "own_doc", "own_key", "cut_doc", "cut_key", "cuts")
    cuts = merged.groupBy(F.col("doc_id").alias(cut_doc), F.col("text_key").alias(cut_key)).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias(cut)
    )
    same = F.col(doc).eqNullSafe(F.col(cut_doc)) & (F.col(key) == F.col(cut_key))
    joined = with_key(docs, doc, key).join(cuts, same, "left")
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(cut, lambda c: c["end"]))
    between = F.zip_with(cut, F.slice(ends, 1, F.size(cut)), lambda c, end: F.concat(
        F.substring(F.col("text"), (end + 1).cast("int"), (c["start"] - end).cast("int")), F.lit("["), F.upper(c["kind"]), F.lit("]")
    ))
    last = F.element_at(F.col(cut), -1)["end"]
    rest = F.substring(F.col("text"), (last + 1).cast("int"), F.char_length("text"))
    changed = F.col(cut).isNotNull()
    out = joined.withColumn("text", F.when(changed, F.concat(F.array_join(between, ""), rest)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn("n_chars", F.when(changed, size).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
