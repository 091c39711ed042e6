"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window is ``WINDOW_WORDS`` consecutive words of a benchmark item, or all of a shorter item. A document that
holds a window holds every word of it, so one word is a sufficient prefix: the one that is rarest in the whole
corpus. Only document positions with such a word become candidates. The position of the word in the window
gives the place where the window must start; length and place bounds come next, then the exact comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeledger.llm.common import LOWER, UPPER, unused, with_key
from cladeledger.workspace import materialize

WINDOW_WORDS = 10
# Words or windows up to which a benchmark table is sent to every executor; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEY = ["doc_id", "text_key"]


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, _GAP, -1), "")


def _documents(docs: DataFrame) -> DataFrame:
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key.alias("text_key"), words_of(F.col("text")).alias("words"))


def _bounded(df: DataFrame) -> tuple[DataFrame, bool]:
    small = df.count() <= BROADCAST_ROWS
    return (F.broadcast(df) if small else df), small


def windows(benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """Distinct ``window`` word lists with the ``items`` they come from. Null and wordless items have none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    cut = F.transform(starts, lambda i: F.slice("words", i, size))
    each = items.filter(F.size("words") > 0).select("item_id", F.explode(cut).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item_id").alias("items"))


def prefixes(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``token``, ``offset``, ``window``, ``items``: each window under its rarest word, counted over all documents.

    A window with a word that no document has cannot occur and is left out.
    """
    found = materialize(windows(benchmark, size), "windows")
    vocabulary, _ = _bounded(found.select(F.explode("window").alias("token")).distinct())
    corpus = _documents(docs).select(F.explode("words").alias("token"))
    frequency = corpus.join(vocabulary, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    placed = found.select(F.xxhash64("window").alias("id"), F.posexplode("window").alias("offset", "token"))
    ranked = placed.join(frequency, "token", "left").groupBy("id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rarest")
    )
    chosen = ranked.filter("rarest.n > 0").select("id", "rarest.token", "rarest.offset")
    keyed = found.withColumn("id", F.xxhash64("window")).join(chosen, "id")
    return materialize(keyed.select("token", "offset", "window", "items"), "prefixes")


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``doc_id``, ``text_key``, ``start``, ``stop`` and ``items`` of every occurrence of a window in a text."""
    prefix, small = _bounded(prefixes(docs, benchmark, size))
    documents = _documents(docs)
    start = F.col("pos") - F.col("offset")
    length = F.size("window")
    inside = (start >= 0) & (start + length <= F.col("n_words"))
    if small:
        tokens = documents.select(*_KEY, "words", F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "token"))
        near = tokens.join(prefix, "token").filter(inside)
    else:
        # The shuffled rows carry no words; a text's words come back for its candidates only.
        tokens = documents.select(*_KEY, F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "token"))
        candidates = tokens.join(prefix, "token").filter(inside)
        own = documents.dropDuplicates(_KEY).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "words")
        near = candidates.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    exact = F.slice("words", start + 1, length) == F.col("window")
    return near.filter(exact).select(*_KEY, start.alias("start"), (start + length).alias("stop"), "items")


def _hits(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    found = occurrences(docs, benchmark, size).groupBy(*_KEY).agg(
        F.collect_set(F.struct("start", "stop")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    covered = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).alias("reach"), F.lit(0).cast("bigint").alias("n")),
        lambda seen, span: F.struct(
            F.greatest(seen["reach"], span["stop"]).alias("reach"),
            (seen["n"] + F.greatest(F.lit(0), span["stop"] - F.greatest(seen["reach"], span["start"]))).cast("bigint").alias("n"),
        ),
        lambda seen: seen["n"],
    )
    return found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), covered.alias("n_hit"), F.sort_array("items").alias("items"))


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` and ``items``.

    Null and wordless texts have no words and no hits. Repeated rows are each judged alike. Items without a
    window never occur; items with a null id make hits but are not listed. An empty benchmark hits nothing.
    """
    counted = _documents(docs).select(*_KEY, F.size("words").cast("bigint").alias("n_words"))
    joined = counted.join(_hits(docs, benchmark, size), _same(), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"), items.alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs`` whose text holds no window, with their own columns."""
    doc, key, hit_doc, hit_key = unused(docs, "own_doc", "own_key", "hit_doc", "hit_key")
    hit = _hits(docs, benchmark, size).select(F.col("_id").alias(hit_doc), F.col("_key").alias(hit_key))
    same = F.col(doc).eqNullSafe(F.col(hit_doc)) & (F.col(key) == F.col(hit_key))
    return with_key(docs, doc, key).join(hit, same, "left_anti").select(*docs.columns)
