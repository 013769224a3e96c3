"""Token-id output (1): binary shards of Re-Pair compressed ids, with expansion lengths for random access."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .chunks import ChunkCoder, text_rounds
from .shared import only, shuffle_partitions, staged, table

MAGIC = b"RPG1"
#: Ids that a block (one grammar) holds, about; a longer document is a block of its own.
BLOCK_IDS = 1 << 20
#: Rounds of replacement, rules that a round makes at most, and occurrences that a pair needs.
ROUNDS, ROUND_RULES, LEAST_COUNT = 6, 2700, 4
#: Slots in which pairs are counted.
SLOT_BITS = 18
#: The id that ends each document.
END_ID = 2


class LibraryCoder(ChunkCoder):
    """Encodes with the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        super().__init__(json.loads(self.tokenizer.to_str()))

    def ids_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.int32), np.fromiter(map(len, ids), np.int64, len(ids))


def _frequent_pairs(key: np.ndarray, last: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, here, rank): all pairs that are frequent enough, most frequent first, where they are, and which is there."""
    there = np.flatnonzero(~last[:-1])
    pairs, which, hits = np.unique(key[there], return_inverse=True, return_counts=True)
    full = np.flatnonzero(hits >= LEAST_COUNT)
    full = full[np.argsort(-hits[full], kind="stable")[:room]]
    chosen = np.full(len(pairs), -1, np.int64)
    chosen[full] = np.arange(len(full))
    rank = chosen[which]
    return pairs[full], there[rank >= 0], rank[rank >= 0].astype(np.int32)


def _frequent_slots(key: np.ndarray, last: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _frequent_pairs, but counted by hash slot: a slot stands for one of the pairs that fall into it; others wait for
    another round, with other symbols."""
    spread = key.dtype.type(0x9E3779B1 if key.itemsize == 4 else 0x9E3779B97F4A7C15)
    slot = ((key * spread) >> key.dtype.type(8 * key.itemsize - SLOT_BITS)).astype(np.int64)
    slot[last[:-1]] = 1 << SLOT_BITS
    hits = np.bincount(slot, minlength=(1 << SLOT_BITS) + 1)[:-1]
    full = np.flatnonzero(hits >= LEAST_COUNT)
    full = full[np.argsort(-hits[full], kind="stable")[:room]]
    chosen = np.full((1 << SLOT_BITS) + 1, -1, np.int32)
    chosen[full] = np.arange(len(full))
    rank = chosen[slot]
    here = np.flatnonzero(rank >= 0)
    rank = rank[here]
    pairs = np.zeros(len(full), key.dtype)
    pairs[rank[::-1]] = key[here[::-1]]
    true = pairs[rank] == key[here]
    return pairs, here[true], rank[true]


def compress(ids: np.ndarray, last: np.ndarray, base: int, rounds: int | None = ROUNDS, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds: (sequence, last, rules). last marks the end of each document; pairs don't cross it.

    Each round counts all adjacent pairs (by hash slot), takes the most frequent ones and replaces each by a nonterminal, base + its
    rule's number, where no overlapping pair is more frequent. It ends after `rounds`, or when the symbols would exceed
    `most`. With rounds None pairs are counted exactly and replaced until none occurs LEAST_COUNT times.
    """
    narrow = most <= 1 << 16  # pairs of 16-bit symbols fit 32 bits
    seq, last = ids.astype(np.uint32 if narrow else np.uint64), last.copy()
    shift = seq.dtype.type(16 if narrow else 32)
    rules: list[np.ndarray] = []
    n_rules = 0
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        room = most - base - n_rules if rounds is None else min(ROUND_RULES, most - base - n_rules)
        if room <= 0 or len(seq) < 2:
            break
        key = seq[:-1] << shift | seq[1:]
        full, here, rank = (_frequent_pairs if rounds is None else _frequent_slots)(key, last, room)
        if not len(full):
            break
        pairs = full
        prio = np.full(len(seq) + 1, len(full) + 1, np.int32)
        prio[here] = rank
        before = np.where(here > 0, prio[here - 1], len(full) + 1)
        place = np.arange(len(here))  # in a stretch of one symbol, where a pair overlaps itself, every other one goes
        odd = (place - np.maximum.accumulate(np.where(rank == before, 0, place))) & 1
        here = here[((rank < before) | (rank == before) & (odd == 0)) & (rank <= prio[here + 1])]
        used = np.bincount(prio[here], minlength=len(pairs))
        worth = used >= 2
        number = np.cumsum(worth) - 1
        here = here[worth[prio[here]]]
        if not len(here):
            break
        kept = pairs[worth]
        rules.append(np.stack([kept >> shift, kept & ((seq.dtype.type(1) << shift) - seq.dtype.type(1))], axis=1).astype(np.int64))
        seq[here] = base + n_rules + number[prio[here]]
        last[here] = last[here + 1]
        stay = np.ones(len(seq), bool)
        stay[here + 1] = False
        seq, last = seq[stay], last[stay]
        n_rules += len(kept)
    return seq, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for; rules refer to earlier ones only."""
    out = np.ones(len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1)
    return out


def pack(doc_ids: list[int | None], docs: list[np.ndarray], base: int, rounds: int | None = ROUNDS) -> bytes:
    """A block of the file format: header, rules, their expansion lengths, the documents' directory, the sequence.

    rounds as in compress; with None symbols take 32 bits where 16 don't do.

    Little-endian. Header: magic, symbol width in bytes, base, documents, ids, rules, symbols. Directory, by column:
    null flag, doc_id, ids, symbols of each document.
    """
    sizes = np.array([len(d) for d in docs], np.int64)
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    last = np.zeros(len(flat), bool)
    last[np.cumsum(sizes) - 1] = True
    seq, last, rules = compress(flat, last, base, rounds, most=1 << 16 if base < 1 << 16 and rounds is not None else 1 << 31)
    ends = np.flatnonzero(last) + 1
    symbols = np.diff(np.r_[0, ends])
    width = 2 if base + len(rules) <= 1 << 16 else 4
    head = MAGIC + struct.pack("<BIIQIQ", width, base, len(docs), len(flat), len(rules), len(seq))
    parts = [rules.astype("<u4"), expansion_lengths(rules, base).astype("<u4"), np.array([d is None for d in doc_ids], "u1"), np.array([d or 0 for d in doc_ids], "<i8"), sizes.astype("<u4"), symbols.astype("<u4"), seq.astype(f"<u{width}")]
    return head + b"".join(p.tobytes() for p in parts)


class Block:
    """Reads a block; any document, or any stretch of one, expands on its own."""

    def __init__(self, data: bytes):
        assert data[:4] == MAGIC, "not a block of ids"
        width, self.base, n, self.n_ids, r, s = struct.unpack_from("<BIIQIQ", data, 4)
        at = 4 + struct.calcsize("<BIIQIQ")

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.rules, self.lengths = take("<u4", 2 * r).reshape(-1, 2).astype(np.int64), take("<u4", r).astype(np.int64)
        null = take("u1", n)
        self.doc_ids = [None if z else d for z, d in zip(null.tolist(), take("<i8", n).tolist())]
        self.sizes, symbols = take("<u4", n).astype(np.int64), take("<u4", n).astype(np.int64)
        self.begin = np.r_[0, np.cumsum(symbols)]
        self.seq = take(f"<u{width}", s).astype(np.int64)
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of every rule, one after the other, and where each begins."""
        if self._flat is None:
            seq = np.arange(self.base, self.base + len(self.rules))
            while (rule := seq >= self.base).any():
                size = 1 + rule
                begin = np.cumsum(size) - size
                out = np.empty(int(size.sum()), np.int64)
                out[begin[~rule]] = seq[~rule]
                pair = self.rules[seq[rule] - self.base]
                out[begin[rule]], out[begin[rule] + 1] = pair[:, 0], pair[:, 1]
                seq = out
            self._flat = seq, np.cumsum(self.lengths) - self.lengths
        return self._flat

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """The ids that the symbols stand for."""
        flat, begin = self.expansions()
        rule = seq >= self.base
        size = np.ones(len(seq), np.int64)
        size[rule] = self.lengths[seq[rule] - self.base]
        source = np.concatenate([flat, seq])
        at = len(flat) + np.arange(len(seq))
        at[rule] = begin[seq[rule] - self.base]
        stop = np.cumsum(size)
        return source[np.repeat(at - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the k-th document: only the symbols that cover them are expanded."""
        seq = self.seq[self.begin[k] : self.begin[k + 1]]
        if start == 0 and stop is None:
            return self.expand(seq)
        stop = int(self.sizes[k]) if stop is None else min(stop, int(self.sizes[k]))
        if start >= stop:
            return np.zeros(0, np.int64)
        size = np.ones(len(seq), np.int64)
        size[seq >= self.base] = self.lengths[seq[seq >= self.base] - self.base]
        end = np.cumsum(size)
        a, b = int(np.searchsorted(end, start, "right")), int(np.searchsorted(end, stop, "left")) + 1
        before = int(end[a - 1]) if a else 0
        return self.expand(seq[a:b])[start - before : stop - before]

    def documents(self) -> list[np.ndarray]:
        return np.split(self.expand(self.seq), np.cumsum(self.sizes)[:-1]) if len(self.sizes) else []


_coders: dict[str, LibraryCoder] = {}


def coder_of(path: str) -> LibraryCoder:
    """One coder per worker process and file."""
    if path not in _coders:
        _coders[path] = LibraryCoder(path)
    return _coders[path]


BLOCKS_SCHEMA = "shard int, block int, rel_start long, n_docs long, n_ids long, payload binary"


def _written(path: str, base: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        shard = TaskContext.get().partitionId()
        block, rel, names, docs, n = 0, 0, [], [], 0

        def emit() -> pa.RecordBatch:
            row = [shard, block, rel, len(docs), n, pack(names, docs, base)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["shard", "block", "rel_start", "n_docs", "n_ids", "payload"])

        end = np.array([end_id], np.int32)
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, part in text_rounds(b.column(1).to_pylist()):
                for k, x in enumerate(coder.encode(part)):
                    if docs and n + len(x) + 1 > BLOCK_IDS:
                        yield emit()
                        block, rel, names, docs, n = block + 1, rel + n, [], [], 0
                    names.append(ids[at + k])
                    docs.append(np.r_[x, end])
                    n += len(x) + 1
        if docs:
            yield emit()

    return run


def write_ids(docs: DataFrame, path: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Encodes all whole texts in doc_id order (null ids first) into shards of blocks; returns the written table of blocks.

    A null text is empty; each document gets end_id. Each range of ids is one shard, sorted, written by one task block
    by block; rel_start counts the ids before a block in its shard. An empty table gives no block.
    """
    from tokenizers import Tokenizer

    path = path or vocabulary_path()
    base = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id + 1)
    n = partitions or shuffle_partitions(docs.sparkSession)
    ordered = only(docs, "doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return staged(ordered.mapInArrow(_written(path, base, end_id), BLOCKS_SCHEMA), "ids")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start, payload in zip(b.column(0).to_pylist(), b.column(1)):
            block = Block(payload.as_buffer().to_pybytes())
            ids = block.documents()
            starts = start + np.cumsum(block.sizes) - block.sizes
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array(starts), pa.array(block.sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the written blocks.

    Shards' totals are added up in shard order; there is one row per shard, at most the number of partitions written.
    """
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    placed = blocks.select("shard", "rel_start", "payload").join(F.broadcast(starts), "shard")
    return placed.select((F.col("shard_start") + F.col("rel_start")).alias("start"), "payload").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """write_ids and read_digests over the whole table of documents.

    Rows that repeat a doc_id are documents of their own, in the order of their texts.
    """
    return read_digests(write_ids(table(spark, sf_dir, "documents")))
