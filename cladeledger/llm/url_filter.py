"""URL rules looked up in a Bloom filter cascade, which is exact over the corpus's own keys.

A rule is a host and a path start. The keys of a URL are its host and every parent domain, each with the start of
its path at every length that rules have. The universe is all keys of the corpus. Level 0 of a cascade holds the
listed keys; level 1 those other keys of the universe that level 0 lets through; level 2 the listed keys that
level 1 lets through; and so on until nothing is let through wrongly. A key is listed if the first level that
does not hold it has an odd number. Pages are judged by bit tests alone, without a join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeledger.llm.common import LOWER, UPPER, share
from cladeledger.workspace import materialize

BITS_PER_KEY = 10
PROBES = 4
MIN_BITS = 1 << 10
# All levels together, sent to every task: 64 MiB, for lists of about 30 million keys.
MAX_FILTER_BYTES = 1 << 26
MAX_LEVELS = 40


RULES = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*+)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*+([^?#]*+)", 1)


def _domains(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def keys_of(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """All keys of a URL: each domain followed by the path's start at each length it reaches."""
    starts = F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    starts = F.filter(starts, lambda s: s.isNotNull())
    return F.flatten(F.transform(_domains(host), lambda d: F.transform(starts, lambda s: F.concat(d, s))))


def _positions(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """``PROBES`` bit numbers per key, other ones on every level."""
    with np.errstate(over="ignore"):
        mixed = (hashes ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        second = (mixed * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
        steps = mixed[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * (second ^ (second >> np.uint64(29)) | np.uint64(1))[:, None]
    return steps % np.uint64(bits)


@dataclass
class Cascade:
    """The levels' bits; ``contains`` is exact for keys of the universe that it was built over."""

    levels: list[np.ndarray] = field(default_factory=list)

    def passes(self, level: int, hashes: np.ndarray) -> np.ndarray:
        bits = self.levels[level]
        at = _positions(hashes, level, len(bits) * 8)
        return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        listed = np.zeros(len(hashes), bool)
        left = np.arange(len(hashes))
        for level in range(len(self.levels)):
            held = self.passes(level, hashes[left])
            listed[left[~held]] = level % 2 == 1
            left = left[held]
        listed[left] = len(self.levels) % 2 == 1
        return listed


def _bits(keys: DataFrame, level: int, count: int) -> np.ndarray:
    """Bits of one level, set by tasks on their share of the keys and joined as blocks of 4 KiB."""
    size = max(MIN_BITS, count * BITS_PER_KEY)
    size += -size % 32_768

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[_positions(batch.column(0).to_numpy().view(np.uint64), level, size).ravel()] = True
        blocks = np.packbits(bits, bitorder="little").reshape(-1, 4096)
        for i in np.flatnonzero(blocks.any(axis=1)).tolist():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([blocks[i].tobytes()])], names=["block", "bits"])

    def join(key, frame):
        import pandas as pd

        merged = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in frame["bits"]])
        return pd.DataFrame({"block": [key[0]], "bits": [merged.tobytes()]})

    built = keys.select("hash").mapInArrow(build, "block int, bits binary").groupBy("block").applyInPandas(join, "block int, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for row in built.toLocalIterator():
        out[row["block"] * 4096 : (row["block"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def _passing(keys: DataFrame, cascade: Cascade, level: int) -> DataFrame:
    """Of ``keys``, those that the given level lets through; written, as they decide what the next level holds."""
    shared = share(keys.sparkSession, cascade)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = shared()
        for batch in batches:
            held = cascade.passes(level, batch.column(0).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(held))

    return materialize(keys.select("hash").mapInArrow(keep, "hash long"), "passing")


def build(universe: DataFrame, listed: DataFrame) -> Cascade:
    """A cascade over ``universe`` for the keys of it that are in ``listed``; both have one column, ``key``.

    Keys are told apart by 64-bit hashes. Repeated keys count once. Null keys are left out. An empty list gives a
    cascade that holds nothing. A list too long for ``MAX_FILTER_BYTES`` is refused before anything is built.
    """
    def hashed(df: DataFrame) -> DataFrame:
        return df.filter("key IS NOT NULL").select(F.xxhash64("key").alias("hash")).distinct()

    inside = materialize(hashed(listed), "listed")
    outside = materialize(hashed(universe).join(inside, "hash", "left_anti"), "unlisted")
    cascade, sides, used = Cascade(), [inside, outside], 0
    for level in range(MAX_LEVELS):
        held, others = sides[level % 2], sides[1 - level % 2]
        count = held.count()
        if not count and level:
            return cascade
        used += max(MIN_BITS, count * BITS_PER_KEY) // 8
        if used > MAX_FILTER_BYTES:
            raise ValueError(f"level {level} with {count} keys exceeds {MAX_FILTER_BYTES} bytes; split the list by host")
        cascade.levels.append(_bits(held, level, count))
        sides[1 - level % 2] = _passing(others, cascade, level)
    raise ValueError("the cascade does not end; keys of the list and the corpus share hashes")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per page ``page_id``, ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``, which is ``block`` or ``allow``; a rule listed with both
    blocks. The longest rule that fits wins, whichever its verdict; of equally long ones the first in alphabetical
    order. A page that no rule fits has a null rule and the verdict ``default``: the cascades say that none of its
    keys is listed. A null URL, or one without ``://``, has empty host and path. Repeated pages are each judged.
    """
    listed = rules.select("verdict", F.concat("host", "path").alias("key"), F.char_length("path").alias("length"))
    lengths = sorted(r["length"] for r in listed.select("length").distinct().collect()) or [0]
    parts = pages.select("page_id", *(f(F.col("url").cast("string")).alias(n) for n, f in (("host", host_of), ("path", path_of))))
    keyed = parts.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths))
    universe = materialize(keyed.select(F.explode("keys").alias("key")).distinct(), "universe")
    blocked = listed.filter("verdict = 'block'").select("key")
    allowed = listed.filter("verdict = 'allow'").select("key").join(blocked, "key", "left_anti")
    cascades = (build(universe, blocked), build(universe, allowed))
    shared = share(pages.sparkSession, cascades)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, allow = shared()
        for batch in batches:
            keys, hashes = batch.column("keys"), batch.column("hashes")
            flat = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            in_block, in_allow = block.contains(flat), allow.contains(flat)
            listed = in_block | in_allow
            hits = list(zip(keys.flatten().filter(pa.array(listed)).to_pylist(), in_block[listed].tolist()))
            ends = np.concatenate([[0], np.cumsum(listed)])[hashes.offsets.to_numpy() - hashes.offsets[0].as_py()]
            best = [min(hits[a:b], key=lambda x: (-len(x[0]), x[0]), default=(None, None)) for a, b in zip(ends, ends[1:])]
            rest = [batch.column(n) for n in ("page_id", "host", "path")]
            verdicts = [default if x is None else "block" if x else "allow" for _, x in best]
            columns = [*rest, pa.array([k for k, _ in best], pa.string()), pa.array(verdicts, pa.string())]
            yield pa.record_batch(columns, names=["page_id", "host", "path", "rule", "verdict"])

    kind = dict(pages.dtypes)["page_id"]
    hashed = keyed.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    return hashed.mapInArrow(look_up, f"page_id {kind}, host string, path string, rule string, verdict string")
