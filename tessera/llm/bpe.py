"""BPE encoding and decoding (6): batched numpy merge rounds over the words of many documents."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .chunks import ChunkCoder, text_rounds
from .shared import only, table

#: A single word whose bytes are all their own symbols.
PLAIN_WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[!-/:-@\[-`{-~]+")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class MergeRounds:
    """The merges of a BPE vocabulary as sorted pair keys, applied to many words at once.

    All words' symbols lie in one flat array. Each round finds the rank of every adjacent pair by binary search in the
    sorted keys, takes each word's lowest rank and merges that pair wherever the word holds it, from left to right;
    a pair whose result could take part in an earlier merge is merged only at its first place. Words without a known
    pair leave the array.
    """

    def __init__(self, merges: list[tuple[int, int, int]]):
        first_use: dict[int, int] = {}
        for rank, (a, b, _) in enumerate(merges):
            first_use.setdefault(a, rank)
            first_use.setdefault(b, rank)
        keys = np.array([a << 32 | b for a, b, _ in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.result = np.array([c for *_, c in merges], np.int64)
        self.once = np.array([first_use.get(c, len(merges)) < r for r, (*_, c) in enumerate(merges)], bool)

    def apply(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """symbols: the words' symbols one after the other; lengths: of each word (none is 0). Returns both after all merges."""
        none = len(self.result)
        words = len(lengths)
        word = np.repeat(np.arange(words), lengths)
        sym = symbols.astype(np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            pair = np.full(len(sym), none)
            inner = np.flatnonzero(word[1:] == word[:-1])
            if len(inner) and none:
                key = sym[inner] << 32 | sym[inner + 1]
                at = np.searchsorted(self.keys, key)
                at[at == none] = 0
                known = self.keys[at] == key
                pair[inner[known]] = self.rank[at[known]]
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(pair, start)
            count = np.diff(np.r_[start, len(sym)])
            least_at = np.repeat(least, count)
            finished = least_at == none
            if finished.any():
                done.append((word[finished], sym[finished]))
                sym, word, pair, least_at = sym[~finished], word[~finished], pair[~finished], least_at[~finished]
                if not len(sym):
                    break
            hit = np.flatnonzero(pair == least_at)
            # Of hits that overlap (a run of consecutive places), every second one from the left merges.
            head = np.r_[True, hit[1:] != hit[:-1] + 1]
            offset = np.arange(len(hit)) - np.maximum.accumulate(np.where(head, np.arange(len(hit)), 0))
            rank = pair[hit]
            first = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            hit = hit[(offset % 2 == 0) & (first | ~self.once[rank])]
            sym[hit] = self.result[pair[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, word = sym[stay], word[stay]
        if not done:
            return symbols.astype(np.int64), lengths
        word = np.concatenate([w for w, _ in done])
        sym = np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=words)


class Codec(ChunkCoder):
    """Encodes and decodes as the tokenizers library does with a word-end BPE file (add_special_tokens=False).

    Words come from ChunkCoder, or, beyond Latin-1, from the library's own normaliser and pre-tokeniser; they are
    mapped to the byte alphabet by its byte-level step; the merges run here.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        prefix = len(model.get("continuing_subword_prefix") or "")
        self.rounds = MergeRounds([(vocab[a], vocab[b], vocab[a + b[prefix:]]) for a, b in pairs])
        self.vocab = vocab
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        names = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            names[i] = token
        self.names = [t.encode() for t in names]
        super().__init__(spec)

    def _words(self, chunk: str) -> list[str]:
        if PLAIN_WORD.fullmatch(chunk):
            return [chunk]
        chunk = self.tokenizer.normalizer.normalize_str(chunk) if self.tokenizer.normalizer else chunk
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chunk)]

    def ids_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        symbols: list[int] = []
        lengths: list[int] = []
        owner: list[int] = []
        vocab, suffix = self.vocab, self.suffix
        for k, chunk in enumerate(chunks):
            parts = self.specials.split(chunk) if self.specials and "<" in chunk else [chunk]
            for part in parts:
                if part in self.special:
                    symbols.append(self.special[part])
                    lengths.append(1)
                    owner.append(k)
                    continue
                for w in self._words(part) if part else ():
                    ids = [vocab[c] for c in w[:-1] if c in vocab]
                    last = vocab.get(w[-1] + suffix)
                    ids += [] if last is None else [last]
                    if ids:
                        symbols += ids
                        lengths.append(len(ids))
                        owner.append(k)
        sym, size = self.rounds.apply(np.array(symbols, np.int64), np.array(lengths, np.int64)) if symbols else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        per = np.bincount(np.array(owner, np.int64), weights=size, minlength=len(chunks)).astype(np.int64) if len(owner) else np.zeros(len(chunks), np.int64)
        return sym, per

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8: the file names no decoder, so tokens are joined by spaces."""
        return b" ".join(map(self.names.__getitem__, ids.tolist()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _encoded(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for at, part in text_rounds(texts):
                ids = c.encode(part)
                n = pa.array([len(i) for i in ids], pa.int64())
                raw = [i.astype("<u4") for i in ids]
                head = [b.column(0).slice(at, len(part)), n]
                if digests:
                    yield pa.RecordBatch.from_arrays([*head, pa.array([hashlib.sha256(r.tobytes()).hexdigest() for r in raw]), pa.array([hashlib.sha256(c.decode(i)).hexdigest() for i in ids])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([*head, pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(i).decode() for i in ids])], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), decoded (string) of each whole text; null counts as empty, other columns go."""
    return only(docs, "doc_id", "text").mapInArrow(_encoded(path or vocabulary_path(), False), "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, from the same encoding and decoding."""
    return only(docs, "doc_id", "text").mapInArrow(_encoded(path or vocabulary_path(), True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode_digests over the whole table of documents: a row per row, repeated ones and null ids included."""
    return encode_digests(table(spark, sf_dir, "documents"))
