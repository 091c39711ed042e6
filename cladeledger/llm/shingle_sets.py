"""Sets of hashed word shingles of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from cladeledger.llm.common import LOWER, UPPER

SHINGLE_WORDS = 5
SPACES = b"\x20\t\n\x0b\x0c\r"
GROUP_BYTES = 500_000
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _tables() -> tuple[bytes, np.ndarray, np.ndarray]:
    """Lower case with blanks as spaces, which bytes are blank, and a number per byte."""
    plain = bytes.maketrans(UPPER.encode() + SPACES, LOWER.encode() + b" " * len(SPACES))
    blank = np.zeros(256, bool)
    blank[list(SPACES)] = True
    return plain, blank, mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _word_hashes(data: bytes, tables) -> np.ndarray:
    """One number per word of ``data``."""
    plain, blank, values = tables
    letters = np.frombuffer(data.translate(plain), np.uint8)
    inside = ~blank[letters]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, np.uint64)
    first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    lengths = np.diff(np.r_[first, len(at)])
    # Odd multipliers, so no byte's value is lost.
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.arange(len(at)) - np.repeat(first, lengths)
    sums = np.add.reduceat(values[letters[at]] * powers[place], first)
    return mix(sums + lengths.astype(np.uint64))


@dataclass
class Sets:
    """Texts' sets one after the other: ``hashes[bounds[i]:bounds[i + 1]]`` are those of text *i*, in order."""

    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def keys(self) -> np.ndarray:
        """A number per text, the same for equal sets; 0 for empty ones."""
        sums = np.r_[np.uint64(0), np.cumsum(mix(self.hashes ^ np.uint64(_BASE)), dtype=np.uint64)]
        sums = sums[self.bounds[1:]] - sums[self.bounds[:-1]]
        return np.where(self.sizes > 0, mix(sums + self.sizes.astype(np.uint64)), np.uint64(0))


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts of about ``GROUP_BYTES`` that end with a blank."""
    start = 0
    while len(text) - start > GROUP_BYTES:
        stop = start + GROUP_BYTES
        while stop < len(text) and text[stop] not in SPACES:
            stop += 1
        yield text[start:stop]
        start = stop
    yield text[start:]


def shingle_sets(texts: Sequence[bytes], size: int = SHINGLE_WORDS) -> Sets:
    """Distinct shingles of ``size`` words of each text; all words as one where there are fewer, none without words."""
    tables = _tables()
    if len(texts) == 1:
        words = np.concatenate([_word_hashes(p, tables) for p in _pieces(texts[0])])
        counts = np.array([len(words)])
    else:
        joined = b" ".join(texts)
        words = _word_hashes(joined, tables)
        ends = np.cumsum([len(t) + 1 for t in texts])
        letters = ~tables[1][np.frombuffer(joined, np.uint8)]
        starts = np.flatnonzero(letters & np.r_[True, ~letters[:-1]])
        counts = np.diff(np.r_[0, np.searchsorted(starts, ends)])
    stops = np.cumsum(counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(words)) - np.repeat(stops - counts, counts)
    at = np.flatnonzero((place + size <= counts[owner]) | (place == 0))
    owner = owner[at]
    hashes = words[at]
    for step in range(1, size):
        inside = at + step < stops[owner]
        following = np.where(inside, words[np.minimum(at + step, len(words) - 1)], np.uint64(step)) if len(at) else hashes
        hashes = mix(hashes * np.uint64(_BASE) + following)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])] if len(at) else np.empty(0, bool)
    return Sets(np.r_[0, np.cumsum(np.bincount(owner[new], minlength=len(texts)))], hashes[new])


def grouped(texts: Sequence[bytes], group_bytes: int = GROUP_BYTES) -> Iterator[tuple[int, int, Sets]]:
    """The sets of texts ``start`` to ``stop``, about ``group_bytes`` at a time."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= group_bytes or i + 1 == len(texts):
            # A text that alone fills a group is taken by itself.
            if len(text) >= group_bytes and i > start:
                yield start, i, shingle_sets(texts[start:i])
                start = i
            yield start, i + 1, shingle_sets(texts[start : i + 1])
            start, held = i + 1, 0
