"""Near-duplicates by the Jaccard similarity of their word shingles, with rare-first prefix filtering.

All sets are ordered the same way, the rarest shingles first. Two sets that are similar enough share a shingle among
the first few of both, so only sets that meet there are compared. A meeting must also pass the length filter, the
positional filter (what can still follow in both), the bitmap filter (shingles that leave an odd count under some bit
are in one of the two only) and the suffix filter (how the rest of both falls between the same pivots); what is left is
verified once per pair.

A shingle of one set alone can join nothing. It takes up room at the front of its set, and a set with enough of them
has no candidates at all. ``screened`` finds most such sets before any shingle travels as a row.

Copies meet as one set. Only connected components are wanted, so a cell of sets that meet at a shingle first offers
each of its sets a few pairs, with pivots of the cell; sets that are connected already need no more pairs. When pairs
with pivots yield few links any more, all that are open are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeledger.llm.common import texts
from cladeledger.llm.components import components
from cladeledger.llm.shingle_sets import grouped
from cladeledger.workspace import materialize

# Similar from NUMERATOR / DENOMINATOR on.
NUMERATOR, DENOMINATOR = 4, 5
# Screening: the share of all shingles that is looked at, how many a task counts and a batch holds, bytes of each.
SCREENED = 0.4
PART_TOKENS = 1_500_000
CHUNK_TOKENS = 1_500_000
CUT_BYTES = 5
SALTS = 64
PIVOTS = 7
CELL_PIVOTS = 4
# Numbers of 64 bits that tell of each set which bits an odd count of its shingles falls on.
WORDS = 8
# Rows of texts or of pairs of sets that go to a task's Python at once.
BATCH_ROWS = 1000
# So many keys of sets that are compared are sent to the tasks that read the texts.
SENT_KINDS = 1_000_000
# Links of a round of pivots for each set, at most, when the rounds end.
LEAST_YIELD = 0.1

_SET = "kind bigint, n bigint, tokens array<bigint>"
_PRINT = "doc_id bigint, key_a bigint, key_b bigint, kind bigint, n bigint, possible boolean"


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with two columns without nulls that are equal where both of these are."""
    rows = texts(docs)
    key = F.xxhash64(F.col("doc_id").isNull(), "text")
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("key_a"), key.alias("key_b"), "text")


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def screened(docs: DataFrame) -> DataFrame:
    """Of each row its id, its keys, ``kind`` (the same for equal sets), ``n``, the size of its set, and ``possible``.

    A similar set shares four fifths of a set's shingles, so it misses at most a fifth of them, also among any part
    of the set. Here the part are shingles with a hash below a bound, the same for all. Packed lists of them go to one
    task per range of hashes, which tells how many of each row's some other row has too; where these are too few the
    row cannot be similar to any other. Cut hashes that meet by chance only let a row pass. ``possible`` is null for a
    row that has an equal in its batch; one of them stands for the others.

    A task's rows must come in the same order if it runs again, as those of a written table do.
    """
    rows = _keyed(docs)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, round(chars * SCREENED / 6 / PART_TOKENS))
    width = -(-int(SCREENED * (1 << 64)) // parts)
    cut = max(0, width.bit_length() - 8 * CUT_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            values = batch.column("text").cast(pa.binary()).to_pylist()
            for start, stop, sets in grouped(values):
                held.append((batch.select(["doc_id", "key_a", "key_b"]).slice(start, stop - start), sets))
                size += len(sets.hashes)
                if size > CHUNK_TOKENS:
                    yield packed(base, held)
                    base, held, size = base + 1, [], 0
        if held:
            yield packed(base, held)

    def packed(chunk: int, held: list) -> pa.RecordBatch:
        ids = [pa.concat_arrays([part.column(c) for part, _ in held]) for c in ("doc_id", "key_a", "key_b")]
        kinds, sizes, hashes = (np.concatenate([getattr(sets, x) for _, sets in held]) for x in ("keys", "sizes", "hashes"))
        owners = np.repeat(np.arange(len(sizes)), sizes)
        first = np.zeros(len(kinds), bool)
        first[np.unique(kinds, return_index=True)[1]] = True
        chosen = (hashes < np.uint64(int(SCREENED * (1 << 64)))) & first[owners]
        hashes, owners = hashes[chosen], owners[chosen]
        taken = np.where(first, np.bincount(owners, minlength=len(sizes)), -1)
        book = np.stack([ids[0].is_valid().to_numpy(zero_copy_only=False), *(x.fill_null(0).to_numpy() for x in ids), kinds.view(np.int64), sizes, taken], 1)
        order = np.argsort(hashes)
        hashes, owners = hashes[order], owners[order]
        bounds = np.searchsorted(hashes, np.array([p * width for p in range(parts)], np.uint64)).tolist() + [len(hashes)]
        out = [(-1 - chunk % parts, chunk, book.astype("<i8").tobytes(), b"")]
        for part, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if a < b:
                short = (hashes[a:b] - np.uint64(part * width)) >> np.uint64(cut)
                out.append((part, chunk, _planes(np.diff(short, prepend=np.uint64(0)), CUT_BYTES), _planes(owners[a:b], 4)))
        kinds_of = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds_of)], names=["part", "chunk", "body", "owners"])

    def count(key, table):
        if key[0].as_py() < 0:
            return table.select(["chunk", "body", "owners"])
        shorts = [np.cumsum(_whole(x.as_buffer(), CUT_BYTES)) for x in table["body"]]
        tokens, found = np.unique(np.concatenate(shorts), return_counts=True)
        shared = tokens[found > 1]
        replies = []
        for short, owners in zip(shorts, table["owners"]):
            at = np.minimum(np.searchsorted(shared, short), max(len(shared) - 1, 0))
            again = shared[at] == short if len(shared) else np.zeros(len(short), bool)
            replies.append(_planes(np.sort(_whole(owners.as_buffer(), 4)[again]), 4))
        return pa.table({"chunk": table["chunk"], "body": pa.array([b""] * len(replies), pa.binary()), "owners": pa.array(replies, pa.binary())})

    def judge(key, table):
        book = np.frombuffer(b"".join(table["body"].to_pylist()), "<i8").reshape(-1, 7)
        known, doc_id, key_a, key_b, kind, n, taken = book.T
        owners = np.concatenate([_whole(x.as_buffer(), 4) for x in table["owners"]]).astype(np.int64)
        again = np.bincount(owners, minlength=len(book))
        possible = (n > 0) & (again >= taken - (n - (n * NUMERATOR + DENOMINATOR - 1) // DENOMINATOR))
        return pa.table({
            "doc_id": pa.array(doc_id, mask=known == 0), "key_a": key_a, "key_b": key_b, "kind": kind, "n": n,
            "possible": pa.array(possible, mask=taken < 0),
        })

    sent = rows.mapInArrow(send, "part bigint, chunk bigint, body binary, owners binary")
    replied = sent.groupBy("part").applyInArrow(count, "chunk bigint, body binary, owners binary")
    return materialize(replied.groupBy("chunk").applyInArrow(judge, _PRINT), "prints")


def _planes(values: np.ndarray, size: int) -> bytes:
    """The lowest ``size`` bytes of each value, all lowest bytes first, so that zeros lie together and compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _whole(data: pa.Buffer, size: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.view("<u8").ravel()


def sets_of(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """``kind``, ``n`` and ``tokens`` (the hashed shingles) of each of ``kinds``, from the row that its keys name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("text").cast(pa.binary()).to_pylist()
            for start, stop, sets in grouped(values):
                tokens = pa.ListArray.from_arrays(pa.array(sets.bounds, pa.int32()), _signed(sets.hashes))
                yield pa.record_batch([batch.column("kind").slice(start, stop - start), pa.array(sets.sizes, pa.int64()), tokens], names=["kind", "n", "tokens"])

    wanted = kinds.select("kind", "key_a", "key_b")
    # 24 bytes each: a table of known size goes to the texts; a larger one meets them in a shuffle.
    wanted = F.broadcast(wanted) if wanted.count() <= SENT_KINDS else wanted
    rows = _keyed(docs).join(wanted, ["key_a", "key_b"]).select("kind", "text")
    return rows.mapInArrow(run, _SET).groupBy("kind").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))


def _least_overlap(n: str) -> str:
    """The fewest shingles that a set of ``n`` shares with a similar one."""
    return f"({n} * {NUMERATOR} + {DENOMINATOR - 1}) div {DENOMINATOR}"


def least_overlap(n_a, n_b):
    """The fewest shared shingles at which sets of these sizes are similar; columns, numbers or arrays."""
    return ((n_a + n_b) * NUMERATOR + NUMERATOR + DENOMINATOR - 1) // (NUMERATOR + DENOMINATOR)


def ordered(sets: DataFrame) -> DataFrame:
    """``kind``, ``n``, ``tokens`` and ``bits``: what each set shares with any other, rarest first; sets that share too little go.

    A token is one number whose upper bits are its frequency class, a third of an octave wide, and whose lower 56
    are bits of the shingle's hash.
    """
    tokens = sets.select("kind", "n", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    rank = F.expr("shiftleft(least(cast(floor(3 * log2(df)) as bigint), 126L), 56) | shiftrightunsigned(token, 8)")
    lists = tokens.join(shared, "token").select("kind", "n", rank.alias("token"))
    lists = lists.groupBy("kind").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("token")).alias("tokens"))
    return materialize(_with_bits(lists.filter(F.expr(f"size(tokens) >= {_least_overlap('n')}"))), "ordered")


def _with_bits(lists: DataFrame) -> DataFrame:
    """``lists`` with ``bits``, numbers of 64 bits; a bit is 1 if an odd count of the set's tokens falls on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            owners = np.repeat(np.arange(batch.num_rows), tokens.value_lengths().to_numpy())
            places = owners * (64 * WORDS) + tokens.flatten().to_numpy() % (64 * WORDS)
            odd = (np.bincount(places, minlength=batch.num_rows * 64 * WORDS) & 1).astype(np.uint8)
            bits = pa.array(np.packbits(odd, bitorder="little").view("<i8"))
            bounds = pa.array(np.arange(batch.num_rows + 1) * WORDS, pa.int32())
            columns = [batch.column(c) for c in ("kind", "n", "tokens")]
            yield pa.record_batch([*columns, pa.ListArray.from_arrays(bounds, bits)], names=["kind", "n", "tokens", "bits"])

    return lists.select("kind", "n", "tokens").mapInArrow(run, f"{_SET}, bits array<bigint>")


def cells(lists: DataFrame) -> DataFrame:
    """``token``, ``kind``, ``n``, ``alone`` (shingles no other set has, which come first), ``bits`` and ``k``, the place among the others."""
    alone = F.expr("n - size(tokens)")
    prefix = F.expr(f"slice(tokens, 1, cast(size(tokens) - {_least_overlap('n')} + 1 as int))")
    found = lists.select("kind", "n", alone.alias("alone"), "bits", F.posexplode(prefix).alias("k", "token"))
    met = found.groupBy("token").agg(F.min("kind").alias("low"), F.max("kind").alias("high")).filter("low < high")
    return materialize(found.join(met.select("token"), "token"), "cells")


def _may_be_similar(a: str, b: str) -> Column:
    """Length, positional and bitmap filter of two members ``a`` and ``b`` of a cell."""
    most = f"least({a}.k, {b}.k) + least({a}.n - {a}.alone - {a}.k, {b}.n - {b}.alone - {b}.k)"
    least = f"(({a}.n + {b}.n) * {NUMERATOR} + {NUMERATOR + DENOMINATOR - 1}) div {NUMERATOR + DENOMINATOR}"
    # A bit that differs stands for a shingle that only one of both has, as do those that no other set has.
    differ = " + ".join([f"{a}.alone + {b}.alone", *(f"bit_count({a}.bits[{w}] ^ {b}.bits[{w}])" for w in range(WORDS))])
    return F.expr(
        f"{a}.n * {DENOMINATOR} >= {b}.n * {NUMERATOR} and {b}.n * {DENOMINATOR} >= {a}.n * {NUMERATOR} and {most} >= {least} "
        f"and {differ} <= {a}.n + {b}.n - 2 * ({least})"
    )


def _pairs(met: DataFrame) -> DataFrame:
    """Each pair once, with the place of a shared shingle in both; ``met`` has structs ``x`` and ``y``."""
    first = F.col("x.kind") < F.col("y.kind")
    side = lambda yes, no, name: F.when(first, F.col(f"{yes}.{name}")).otherwise(F.col(f"{no}.{name}"))
    found = met.filter(_may_be_similar("x", "y")).select(
        side("x", "y", "kind").alias("a"), side("y", "x", "kind").alias("b"), F.struct(side("x", "y", "k").alias("a"), side("y", "x", "k").alias("b")).alias("k")
    )
    return found.groupBy("a", "b").agg(F.min("k").alias("k"))


def verified(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The similar ones of ``pairs``; a set that very many pairs name is dealt out in ``SALTS`` copies."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    for side, other in (("a", "b"), ("b", "a")):
        salted = salted.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
        needed = salted.select(side, "salt").distinct()
        named = lists.select(F.col("kind").alias(side), F.col("n").alias(f"n_{side}"), F.col("tokens").alias(f"tokens_{side}"))
        salted = salted.join(needed.join(named, side), [side, "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(batch.column(f"tokens_{s}").flatten().to_numpy(), np.r_[0, np.cumsum(batch.column(f"tokens_{s}").value_lengths().to_numpy())]) for s in "ab"]
            sizes = [batch.column(f"n_{s}").to_numpy() for s in "ab"]
            places = [batch.column(f"k_{s}").to_numpy() for s in "ab"]
            least = least_overlap(*sizes)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (tokens[bounds[i] : bounds[i + 1]] for tokens, bounds in sides)
                keep[i] = similar(a, b, int(places[0][i]), int(places[1][i]), int(least[i]))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    wide = salted.select("a", "b", F.col("k.a").alias("k_a"), F.col("k.b").alias("k_b"), "n_a", "n_b", "tokens_a", "tokens_b")
    return wide.mapInArrow(run, "a bigint, b bigint")


def similar(a: np.ndarray, b: np.ndarray, at_a: int, at_b: int, least: int) -> bool:
    """Whether ordered ``a`` and ``b``, which share the shingle at ``at_a`` and ``at_b``, share ``least`` in all."""
    # Suffix filter: between the same pivots, the two rests share no more than the shorter has.
    rest_a, rest_b = a[at_a + 1 :], b[at_b + 1 :]
    pivots = rest_b[len(rest_b) * np.arange(1, PIVOTS + 1) // (PIVOTS + 1)] if len(rest_b) > PIVOTS else rest_b[:0]
    cut_a, cut_b = np.searchsorted(rest_a, pivots), np.searchsorted(rest_b, pivots)
    parts = np.minimum(np.diff(np.r_[0, cut_a, len(rest_a)]), np.diff(np.r_[0, cut_b, len(rest_b)])).sum()
    if min(at_a, at_b) + 1 + parts < least:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum()) >= least


def _placed(found: DataFrame, reach: DataFrame | None) -> DataFrame:
    """Cells with ``root``, the component that each member is in so far."""
    if reach is None:
        return found.withColumn("root", F.col("kind"))
    named = reach.select(F.col("node").alias("kind"), F.col("component").alias("root"))
    return found.join(named, "kind", "left").withColumn("root", F.coalesce("root", "kind"))


_MEMBER = ("kind", "n", "alone", "k", "bits", "root")


def _star_pairs(placed: DataFrame, turn: int) -> DataFrame:
    """Each member of a cell of several components with a few pivots of the cell.

    The first has the least share of shingles of its own, so it is similar to the most; hashes choose the others anew each turn.
    """
    orders = [F.col("alone") / F.col("n"), *(F.xxhash64(F.lit(turn * CELL_PIVOTS + i), "kind").cast("double") for i in range(1, CELL_PIVOTS))]
    pivots = [F.min(F.struct(order.alias("order"), *_MEMBER)) for order in orders]
    mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.array(*pivots).alias("ys"))
    mixed = mixed.filter("low < high").select("token", F.explode(F.array_distinct("ys")).alias("y"))
    met = placed.select("token", F.struct(*_MEMBER).alias("x")).join(mixed, "token")
    return _pairs(met.filter("x.root != y.root"))


def _open_pairs(placed: DataFrame) -> DataFrame:
    """All pairs of members of different components of a cell: one of the two is not of the cell's largest component."""
    sizes = placed.groupBy("token", "root").count()
    main = sizes.groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    mixed = placed.join(main.select("token", "main"), "token")
    left = mixed.filter("root != main").select("token", F.struct(*_MEMBER).alias("x"))
    right = mixed.select("token", F.struct(*_MEMBER, "main").alias("y"))
    both = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.kind") < F.col("y.kind")))
    return _pairs(left.join(right, "token").filter(both))


def links(lists: DataFrame, least_yield: float = LEAST_YIELD) -> DataFrame | None:
    """``node`` and ``component`` of each kind that is linked to another; None without any links.

    Rounds of pairs with pivots go on while they find more than ``least_yield`` links for each set, then all open pairs are
    verified. The yield decides about the work, not the result.
    """
    found = cells(lists)
    enough = least_yield * lists.count()
    reach, known, tested = None, None, None
    turn, done = 0, False
    while True:
        placed = _placed(found, reach)
        pairs = _open_pairs(placed) if done else _star_pairs(placed, turn)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
        new = materialize(verified(pairs, lists), "links")
        n_new = new.count()
        if n_new:
            known = new if known is None else known.union(new)
            reach = materialize(components(known, "a", "b"), "reach")
        if done:
            return reach
        turn, done = turn + 1, n_new <= enough


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, batches of ``BATCH_ROWS`` go to Python: whole texts and pairs of whole sets are wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Each row's ``doc_id``, ``n_shingles`` and ``component_id``, the least ``doc_id`` it is linked to over any path.

    Two rows are linked when their sets of distinct shingles of five words have a similarity of 0.8 or more. Texts of
    fewer words are one shingle; null texts and those without words have none, and are their own component. Repeated
    rows are returned each; equal sets meet as one. A null ``doc_id`` takes part but never names a component, unless
    all of its component are null. Long texts are taken whole, other columns do not matter, an empty table gives no
    rows. Shingles are told apart by 64-bit hashes, 56 of them where sets are compared.
    """
    with _small_batches(docs.sparkSession):
        return _near_duplicates(docs)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    found = screened(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "key_a", "key_b")).alias("first")
    kinds = found.filter("n > 0").groupBy("kind").agg(F.min("doc_id").alias("first_doc"), first, F.bool_and("possible").alias("possible"))
    kinds = materialize(kinds.select("kind", "first_doc", "first.key_a", "first.key_b", "possible"), "kinds")
    compared = materialize(kinds.filter("possible").select("kind", "key_a", "key_b"), "compared")
    reach = links(ordered(materialize(sets_of(docs, compared), "sets")))
    if reach is None:
        rooted = kinds.select("kind", F.col("first_doc").alias("component_id"))
    else:
        named = kinds.join(reach.withColumnsRenamed({"node": "kind", "component": "root"}), "kind", "left")
        named = named.withColumn("root", F.coalesce("root", "kind"))
        least = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
        rooted = materialize(named.join(least, "root").select("kind", "component_id"), "components")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.join(rooted, "kind", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
