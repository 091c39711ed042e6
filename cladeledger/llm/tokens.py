"""Token ids of whole texts with a given public tokenizer file, at word-cache speed inside Spark tasks."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence

import numpy as np

MAX_CACHED_WORDS = 400_000
_GROUP_CHARS = 1_000_000
# Words of a Latin-1 text under the pre-tokenizer pattern of word_bpe_49k.json; a text's lower case is taken first.
_LETTERS, _NUMBERS, _SPACES = "a-zªµºà-öø-ÿß", "0-9²³¹¼½¾", r"\t\n\x0b\x0c\r \x85\xa0"
WORD_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
_FAST_PRE_TOKENIZER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _worker_state() -> dict:
    """Survives between tasks of one Python worker; functions shipped by value start with fresh module globals."""
    return sys.__dict__.setdefault("_word_encoders", {})


class WordEncoder:
    """Ids exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    A byte-pair tokenizer encodes every pre-token by itself, so for Latin-1 texts, whose lower case and
    normal form are plain, words are cut by the tokenizer's own pattern and each distinct word is encoded
    once. Other texts, and tokenizers with another pre-tokenizer, go through the tokenizer whole.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self.dtype = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        parts = json.loads(self._tokenizer.to_str())
        suffix = parts["model"].get("end_of_word_suffix")
        self._fast = bool(suffix) and _FAST_PRE_TOKENIZER in json.dumps(parts["pre_tokenizer"]).encode().decode("unicode_escape")
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if self._fast:
            self._ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self._words = re.compile(WORD_PATTERN)
        self._cache: dict[str, bytes] = {}

    @classmethod
    def of_worker(cls, path: str) -> WordEncoder:
        state = _worker_state()
        if path not in state:
            state[path] = cls(path)
        return state[path]

    def encode_all(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """Ids of each text in order, a group of about a million characters at a time."""
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= _GROUP_CHARS:
                yield from self._encode_group(group)
                group, size = [], 0
        if group:
            yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> list[np.ndarray]:
        words: list[str] = []
        ends: list[int] = []
        for text in texts:
            if self._is_plain(text):
                words += self._words.findall(text.lower())
            ends.append(len(words))
        pieces = self._pieces(words)
        out, start = [], 0
        for text, end in zip(texts, ends):
            if self._is_plain(text):
                out.append(np.frombuffer(b"".join(pieces[start:end]), self.dtype))
            else:
                ids = self._tokenizer.encode(text, add_special_tokens=False).ids
                out.append(np.array(ids, self.dtype))
            start = end
        return out

    def _is_plain(self, text: str) -> bool:
        if not self._fast or "<|" in text:
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def _pieces(self, words: list[str]) -> list[bytes]:
        cache = self._cache
        if len(cache) > MAX_CACHED_WORDS:
            cache.clear()
        pieces = list(map(cache.get, words))
        missing = list({w for w, p in zip(words, pieces) if p is None})
        if missing:
            self._learn(missing)
            pieces = [cache[w] if p is None else p for w, p in zip(words, pieces)]
        return pieces

    def _learn(self, words: list[str]) -> None:
        # Each word ends with exactly one end-of-word token, so one call encodes them all.
        ids = np.array(self._tokenizer.encode(" ".join(words), add_special_tokens=False).ids, self.dtype)
        cuts = (np.flatnonzero(self._ends[ids]) + 1).tolist()
        if len(cuts) == len(words):
            start = 0
            for word, end in zip(words, cuts):
                self._cache[word] = ids[start:end].tobytes()
                start = end
            return
        for word in words:
            self._cache[word] = np.array(self._tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()
