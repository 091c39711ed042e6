"""Cross-tokenizer alignment by interval coalescing.

Two tokenizers cut the same bytes. All their tokens are sorted by start and the running maximum of their ends is
kept; where a start reaches it, both have ended and a group begins. Inside a group, tokens whose bytes overlap are
linked. How many documents hold a linked pair of ids is counted over the whole table.

Neither tokenizer merges over a space that follows a non-blank, so texts are cut there into units. The distinct units
of a batch of texts are encoded once, aligned all together on one line of bytes, and put together to texts again.
Texts of another kind of tokenizer are one unit each.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeledger.llm.common import share, texts
from cladeledger.workspace import materialize

SPACE_MARK = "\u2581"
# Distinct pairs a task holds before it hands their counts on, and that are sent to all tasks at once.
HELD_PAIRS = 2_000_000
SHARED_PAIRS = 4_000_000
_BATCH_CHARS = 4_000_000
_JOINED_UNITS = 20_000

# The characters with Unicode's White_Space property.
BLANKS = "\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_OTHER_BLANKS = BLANKS.replace("\x20", "")
# A space, then all up to the next space that follows a non-blank.
UNIT = f"\x20[{BLANKS}]*[^{BLANKS}]*(?:[{_OTHER_BLANKS}][{BLANKS}]*[^{BLANKS}]*)*"

_COUNTED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
_ALIGNED = f"{_COUNTED}, codes binary, times binary"


def coalesce(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Group number of each interval; a group ends where a start reaches the greatest end before it."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    first = np.r_[True, starts[order][1:] >= reach[:-1]] if len(order) else np.zeros(0, bool)
    groups = np.empty(len(order), np.int64)
    groups[order] = np.cumsum(first) - 1
    return groups


def overlaps(a_starts, a_ends, b_starts, b_ends) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs whose intervals share a byte; each side is sorted and gapless."""
    low = np.searchsorted(b_ends, a_starts, side="right")
    high = np.searchsorted(b_starts, a_ends, side="left")
    counts = high - low
    left = np.repeat(np.arange(len(a_starts)), counts)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}

# Fixed value: how a byte-level tokenizer of this kind cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoders:
    """Ids and the bytes of every id of a byte-level tokenizer (A) and of a sentence-piece one (B)."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(path_a)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of_char = _byte_of_char()
        self.bytes_a: list[bytes] = [b""] * self._a.get_vocab_size()
        for token, i in self._a.get_vocab().items():
            self.bytes_a[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        pieces = [self._b.id_to_piece(i) for i in range(self._b.vocab_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in kind], np.int64) for kind in (self.bytes_a, self.bytes_b))
        self._tables = [(np.frombuffer(b"".join(x), np.uint8), n) for x, n in ((self.bytes_a, self.sizes_a), (self.bytes_b, self.sizes_b))]
        # Pieces hold their spaces in front only, and A's pattern takes blanks in front of words only.
        self.cuts = all(SPACE_MARK not in p.lstrip(SPACE_MARK) for p in pieces) and self._splits_at_spaces()
        self._unit = re.compile(UNIT)
        self._ranks = self._fast()

    def _splits_at_spaces(self) -> bool:
        import json

        parts = json.loads(self._a.to_str())
        before = parts["pre_tokenizer"] or {}
        return parts["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)

    def units(self, text: str) -> list[str]:
        """``text`` begins with a space."""
        return self._unit.findall(text) if self.cuts else [text]

    def _fast(self):
        """The same byte-pair encoder as a rank table, if ids are ranks of merges; else None."""
        import json

        import tiktoken

        model = json.loads(self._a.to_str())["model"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        ranks = {self.bytes_a[i]: i for t, i in model["vocab"].items() if i < 256 + len(merged)}
        if not self.cuts or any(model["vocab"].get(t) != 256 + k for k, t in enumerate(merged)) or len(ranks) != 256 + len(merged):
            return None
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encoded_a(self, texts: list[str]) -> list[list[int]]:
        if self._ranks is not None:
            return [self._ranks.encode_ordinary(t) for t in texts]
        return [x.ids for x in self._a.encode_batch(texts, add_special_tokens=False)]

    def ids_a(self, units: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after the other, and how many each has."""
        if not self.cuts:
            return _flat(self._encoded_a(units))
        # A unit that ends with a blank is a text by itself; of the others, many make one text.
        alone = np.array([u[-1] in BLANKS for u in units], bool)
        order = np.r_[np.flatnonzero(~alone), np.flatnonzero(alone)]
        joined = [units[i] for i in order[: len(units) - alone.sum()].tolist()]
        texts = ["".join(joined[a : a + _JOINED_UNITS]) for a in range(0, len(joined), _JOINED_UNITS)]
        ids, _ = _flat(self._encoded_a(texts + [units[i] for i in np.flatnonzero(alone).tolist()]))
        # No token reaches over the end of a unit, so the bytes tell whose it is.
        stops = np.searchsorted(np.cumsum(self.sizes_a[ids]), np.cumsum(lengths[order]), side="right")
        counts, starts = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        counts[order], starts[order] = np.diff(np.r_[0, stops]), np.r_[0, stops[:-1]]
        return ids[_ranges(starts, counts)], counts

    def ids_b(self, units: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        # The model puts the space in front itself, but gives nothing for a space alone.
        alone = [self._b.piece_to_id(SPACE_MARK)]
        return _flat([x or alone for x in self._b.encode([u[1:] for u in units], num_threads=1)])

    def same_bytes(self, side: int, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the tokens of each unit are its bytes."""
        table, sizes = self._tables[side]
        starts = np.cumsum(sizes) - sizes
        sums = np.r_[0, np.cumsum(sizes[ids])][np.r_[0, np.cumsum(counts)]]
        same = np.diff(sums) == lengths
        if same.all():
            unlike = table[_ranges(starts[ids], sizes[ids])] != data
            if unlike.any():
                same[np.searchsorted(np.cumsum(lengths), np.flatnonzero(unlike), side="right")] = False
            return same
        ends = np.cumsum(lengths)
        for i in np.flatnonzero(same).tolist():
            own = ids[counts[:i].sum() : counts[: i + 1].sum()]
            same[i] = (table[_ranges(starts[own], sizes[own])] == data[ends[i] - lengths[i] : ends[i]]).all()
        return same


def _flat(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)


@dataclass
class Units:
    """Aligned units: counts of tokens, groups and links, the digest's texts, and the linked pairs ``a * |B| + b`` in order."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    texts: list[str]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.encoders = Encoders(path_a, path_b)
        numbers = [str(i) for i in range(max(len(self.encoders.bytes_a), len(self.encoders.bytes_b)))]
        # How an id is written first in a unit, first in a group, after another id, and first of B.
        self._written = [np.array([mark + n for n in numbers], object) for mark in ("", ";", ",", "|")]

    @classmethod
    def of_worker(cls, path_a: str, path_b: str) -> Aligner:
        """Survives between tasks of one Python worker; functions shipped by value start with fresh module globals."""
        state = sys.__dict__.setdefault("_aligners", {})
        if (path_a, path_b) not in state:
            state[path_a, path_b] = cls(path_a, path_b)
        return state[path_a, path_b]

    def align(self, units: Sequence[str]) -> Units:
        encoders = self.encoders
        # The model writes a space as this mark, so the mark itself comes back as a space.
        good = np.array([SPACE_MARK not in u for u in units], bool)
        kept = [u for u, g in zip(units, good.tolist()) if g]
        joined = "".join(kept)
        lengths = np.array(list(map(len, kept)) if joined.isascii() else [len(u.encode()) for u in kept], np.int64)
        data = np.frombuffer(joined.encode(), np.uint8)
        sides = [encoders.ids_a(kept, lengths), encoders.ids_b(kept)]
        same = encoders.same_bytes(0, *sides[0], data, lengths) & encoders.same_bytes(1, *sides[1], data, lengths)
        good[good] = same
        sides = [(ids[np.repeat(same, counts)], counts[same]) for ids, counts in sides]
        # One line of bytes for all: both sides end at the end of a unit.
        sizes = [table[ids] for table, (ids, _) in zip((encoders.sizes_a, encoders.sizes_b), sides)]
        ends = [np.cumsum(x) for x in sizes]
        starts = [e - x for e, x in zip(ends, sizes)]
        groups = coalesce(np.concatenate(starts), np.concatenate(ends))
        left, right = overlaps(starts[0], ends[0], starts[1], ends[1])
        pairs = sides[0][0][left] * len(encoders.bytes_b) + sides[1][0][right]
        (ids_a, n_a), (ids_b, n_b) = sides
        firsts = np.cumsum(n_a) - n_a
        links = np.diff(np.searchsorted(left, np.r_[firsts, len(ids_a)]))
        in_a, in_b = groups[: len(ids_a)], groups[len(ids_a) :]
        counts = [np.zeros(len(units), np.int64) for _ in range(4)]
        n_groups = np.diff(np.r_[in_a[firsts], in_a[-1] + 1]) if len(in_a) else np.empty(0, np.int64)
        for out, values in zip(counts, (n_a, n_b, n_groups, links)):
            out[good] = values
        texts = np.full(len(units), "", object)
        texts[good] = self._texts(ids_a, in_a, n_a, ids_b, in_b, n_b)
        return Units(good, *counts, pairs, texts.tolist())

    def _texts(self, ids_a, in_a, n_a, ids_b, in_b, n_b) -> np.ndarray:
        """``a1,a2|b1;a3|b2`` of each unit."""
        first_a, first_b = (np.r_[True, x[1:] != x[:-1]] if len(x) else np.empty(0, bool) for x in (in_a, in_b))
        mark = np.where(first_a, 1, 2)
        mark[np.cumsum(n_a) - n_a] = 0
        written = [
            np.choose(mark, [t[ids_a] for t in self._written[:3]]) if len(ids_a) else np.empty(0, object),
            np.where(first_b, self._written[3][ids_b], self._written[2][ids_b]),
        ]
        order = np.argsort(np.concatenate([2 * in_a, 2 * in_b + 1]), kind="stable")
        items = np.concatenate(written)[order].tolist()
        stops = np.cumsum(n_a + n_b).tolist()
        out = np.empty(len(n_a), object)
        out[:] = ["".join(items[a:b]) for a, b in zip([0, *stops], stops)]
        return out

    def rows(self, texts: Sequence[str]) -> list[tuple]:
        """Of each text the counts of tokens, groups and links, the digest, and steps between its pairs' codes with their numbers."""
        cut = [self.encoders.units(f" {t}") if t else [] for t in texts]
        number: dict[str, int] = {}
        at = np.fromiter((number.setdefault(u, len(number)) for units in cut for u in units), np.int64)
        found = self.align(list(number))
        lengths = np.array([len(units) for units in cut], np.int64)
        owner = np.repeat(np.arange(len(texts)), lengths)
        bad = np.bincount(owner, ~found.good[at], len(texts)) > 0
        bad |= lengths == 0
        sums = [np.bincount(owner, x[at], len(texts)).astype(np.int64) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
        keep = ~bad[owner]
        at_kept, owner_kept = at[keep], owner[keep]
        links = found.n_links[at_kept]
        starts = (np.cumsum(found.n_links) - found.n_links)[at_kept]
        keys = (np.repeat(owner_kept, links).astype(np.uint64) << np.uint64(32)) | found.pairs[_ranges(starts, links)].astype(np.uint64)
        keys, times = np.unique(keys, return_counts=True)
        codes, bounds = keys & np.uint64(0xFFFFFFFF), np.searchsorted(keys >> np.uint64(32), np.arange(len(texts) + 1)).tolist()
        times, stops = times.astype("<u4"), np.cumsum(lengths).tolist()
        out = []
        for i, (stop, count) in enumerate(zip(stops, lengths.tolist())):
            if bad[i]:
                out.append((0, 0, 0, 0, 0, 0, "", b"", b""))
                continue
            digest = hashlib.sha256(";".join([found.texts[k] for k in at[stop - count : stop].tolist()]).encode()).hexdigest()
            low, high = bounds[i], bounds[i + 1]
            # Steps between sorted codes are small, so their upper bytes are zeros that compress away.
            steps = np.diff(codes[low:high], prepend=np.uint64(0)).astype("<u4")
            out.append((*(int(x[i]) for x in sums), 0, 0, digest, steps.tobytes(), times[low:high].tobytes()))
        return out


def _spans(items: Sequence[str], chars: int = _BATCH_CHARS) -> list[tuple[int, int]]:
    """Runs of items of about ``chars`` characters."""
    out, start, size = [], 0, 0
    for i, item in enumerate(items):
        size += len(item)
        if size >= chars:
            out.append((start, i + 1))
            start, size = i + 1, 0
    return out + [(start, len(items))] if start < len(items) else out


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row its counts, ``groups_sha256`` and its distinct pairs with their numbers, as a written table; sums are still 0."""
    names = [x.split()[0] for x in _ALIGNED.split(", ")][1:]
    kinds = [pa.int64()] * 6 + [pa.string()] + [pa.binary()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of_worker(path_a, path_b)
        for batch in batches:
            values = [t.as_py() for t in batch.column("text")]
            for start, stop in _spans(values):
                columns = zip(*aligner.rows(values[start:stop]))
                ids = batch.column("doc_id").slice(start, stop - start)
                yield pa.record_batch([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *names])

    return materialize(texts(docs).mapInArrow(run, _ALIGNED), "aligned")


def _codes_of(steps: pa.BinaryScalar) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps.as_buffer(), "<u4"), dtype=np.int64)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """``a``, ``code`` (of the pair), ``docs`` (rows that hold it linked) and ``best`` (no pair of the same ``a`` has more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for steps in batch.column("codes"):
                held.append(_codes_of(steps))
                size += len(held[-1])
                if size > HELD_PAIRS:
                    yield _counts(held)
                    held, size = [], 0
        if held:
            yield _counts(held)

    counted = aligned.select("codes").mapInArrow(run, "code bigint, docs bigint").groupBy("code").agg(F.sum("docs").alias("docs"))
    counted = materialize(counted.select(F.expr(f"code div {size_b}").alias("a"), "code", "docs"), "counts")
    most = counted.groupBy("a").agg(F.max("docs").alias("most"))
    return materialize(counted.join(most, "a").select("a", "code", "docs", (F.col("docs") == F.col("most")).alias("best")), "pairs")


def _counts(held: list[np.ndarray]) -> pa.RecordBatch:
    codes, docs = np.unique(np.concatenate(held), return_counts=True)
    return pa.record_batch([pa.array(codes), pa.array(docs.astype(np.int64))], names=["code", "docs"])


def _slices(pairs: DataFrame, largest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes in order with their counts and whether they are best, cut between ids of A; each has ``largest`` pairs or one id's."""
    cuts, held = [0], 0
    for a, count in pairs.groupBy("a").count().orderBy("a").collect():  # one row per id of A at most
        if held and held + count > largest:
            cuts.append(a)
            held = 0
        held += count
    for low, high in zip(cuts, [*cuts[1:], None]):
        part = pairs.filter((F.col("a") >= low) & (F.lit(True) if high is None else F.col("a") < high))
        found = part.select("code", "docs", "best").toArrow().sort_by("code")
        yield tuple(found[c].to_numpy() for c in ("code", "docs", "best"))


def _add_up(aligned: DataFrame, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """``aligned`` with what the links of the table's pairs add to ``n_best`` and ``count_sum``."""
    shared = share(aligned.sparkSession, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = shared()
        for batch in batches:
            n_best, count_sum = [], []
            for steps, times in zip(batch.column("codes"), batch.column("times")):
                codes, times = _codes_of(steps), np.frombuffer(times.as_buffer(), "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
                here = known[at] == codes if len(known) else np.zeros(len(codes), bool)
                at, times = at[here], times[here]
                n_best.append(int(times[best[at]].sum()))
                count_sum.append(int((times * docs[at]).sum()))
            new = {"n_best": n_best, "count_sum": count_sum}
            yield pa.record_batch(
                [
                    pa.array(np.add(column.to_numpy(), new[name]), pa.int64()) if name in new else column
                    for name, column in zip(batch.schema.names, batch.columns)
                ],
                names=batch.schema.names,
            )

    return aligned.mapInArrow(run, _ALIGNED)


def align(docs: DataFrame, path_a: str, path_b: str, shared_pairs: int = SHARED_PAIRS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    Null and empty texts, and those whose tokens have other bytes than a space and the text, have no tokens: zeros and
    an empty digest. Repeated rows count and return each; a null ``doc_id`` stays. Long texts are taken whole. Other
    columns do not matter, whatever their names. An empty table gives no rows.

    Tasks look pairs up in a table of at most ``shared_pairs`` pairs (17 bytes each) or of one id of A, which has at
    most as many as B has ids. If there are more pairs, the documents meet one such table after the other, and their
    sums grow with each.
    """
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()
    aligned = align_documents(docs, path_a, path_b)
    for turn, part in enumerate(_slices(pair_counts(aligned, size_b), shared_pairs)):
        aligned = _add_up(aligned if turn == 0 else materialize(aligned, "aligned"), part)
    return aligned.select(*(x.split()[0] for x in _COUNTED.split(", ")))
