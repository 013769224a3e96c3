"""Encoding of many texts through a cache of their words, or of the strings between spaces."""

from __future__ import annotations

import ctypes
import re
import weakref
from collections.abc import Iterator
from itertools import repeat

import numpy as np

#: Cached chunks of text, at most; the cache starts afresh beyond.
CACHE_CHUNKS = 1_000_000
#: Characters of text that one round of encoding takes at once.
ROUND_CHARS = 4_000_000
#: The word pattern of word_bpe_49k.json, and what it means for lower-case Latin-1 text (letters: \p{L}, digits: \p{N}).
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_WORD = re.compile(r"[a-zß-öø-ÿªµº]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼½¾]|[^\sa-zß-öø-ÿªµº0-9²³¹¼½¾]+")
#: White space to Python's patterns only.
_ODD = re.compile(r"[\x1c-\x1f]")

#: Coders of this process that have cached something.
_filled: weakref.WeakSet[ChunkCoder] = weakref.WeakSet()


def trim() -> None:
    """Gives freed memory back to the system, where the C library can; else a worker that is used again keeps it."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not the GNU C library
        pass


def release_caches() -> None:
    """Gives the coders' caches back to the system. Tasks of other operators call it: they may get a worker that has encoded."""
    if _filled:
        while _filled:
            _filled.pop().clear()
        trim()


class ChunkCoder:
    """Encodes texts chunk by chunk, each distinct chunk once.

    For tokenizers that lower-case, drop white space and cut words by WORD_RULE. Latin-1 texts (no character of theirs
    composes with another) are cut into those words here. Other texts, and those that may hold a special token, are
    cut at spaces only: no rule reaches over a space, and the subclass does the rest.
    """

    def __init__(self, spec: dict):
        """spec: the tokenizer's file."""
        rules = [p["pattern"].get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if "pattern" in p]
        if rules != [WORD_RULE] or not any(n["type"] == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", [])):
            raise ValueError("not a tokenizer that lower-cases and cuts words by WORD_RULE")
        self.clear()

    def cut(self, text: str) -> list[str]:
        if "<|" not in text:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text.split(" ")
            if not _ODD.search(text):
                return LATIN_WORD.findall(text.lower())
        return text.split(" ")

    def ids_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct chunks, one chunk after the other, and how many each has."""
        raise NotImplementedError

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        ids, per = self.ids_of(chunks)
        n, m = len(self.index), len(chunks)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while n + m > len(self.begin):
            self.begin, self.size = np.r_[self.begin, np.zeros_like(self.begin)], np.r_[self.size, np.zeros_like(self.size)]
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[n : n + m] = per
        self.begin[n : n + m] = self.used + np.cumsum(per) - per
        self.used += len(ids)
        self.index.update(zip(chunks, range(n, n + m)))
        _filled.add(self)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as an int32 array."""
        if len(self.index) > CACHE_CHUNKS or self.used > 16 * CACHE_CHUNKS:
            self.clear()
        split = [self.cut(t) or [""] for t in texts]
        chunks = [c for s in split for c in s]
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            self._learn(list({chunks[i] for i in unknown.tolist()}))
            at[unknown] = [self.index[chunks[i]] for i in unknown.tolist()]
        size = self.size[at]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        flat = self.flat[np.repeat((self.begin[at] - (stop - size)).astype(np.int32), size) + np.arange(total, dtype=np.int32)]
        ends = stop[np.cumsum([len(s) for s in split]) - 1] if split else []
        return np.split(flat, ends[:-1]) if len(ends) else []


def text_rounds(texts: list[str | None], chars: int = ROUND_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Slices of the list that hold about so many characters (one text at least), each with its first index; null is empty."""
    at, held, n = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        n += len(held[-1])
        if n >= chars:
            yield at, held
            at, held, n = i + 1, [], 0
    if held:
        yield at, held
