"""Suffix-array dedup (9): long repeated byte strings found through run-compressed Burrows-Wheeler indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import trim
from .shared import numbered, settled, shuffle_partitions, staged, table

#: Bytes of a string that counts as repeated, and of the substrings whose hashes choose its anchor.
LENGTH, GRAM = 400, 64
#: Window starts of a document that are worked on at once.
CHUNK = 1 << 20
#: Bytes of snippets that one index holds, about.
INDEX_BYTES = 1 << 21
#: Different snippets of one anchor that may meet in one index; beyond, the anchor is split.
ANCHOR_SNIPPETS = 2048
#: Window starts of a split anchor that are compared across its indexes at once.
CELL = 32
#: Rows, and intervals in them, that are broadcast to the texts at most (some 100 MB); beyond, texts are shuffled.
BROADCAST_ROWS, BROADCAST_INTERVALS = 600_000, 1_200_000

_TABLE = np.array([xxhash.xxh64_intdigest(bytes([i]), 9) for i in range(256)], np.uint64)
_STEP = 0x9E3779B97F4A7C15


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(lo, hi, fingerprint, place): the window starts lo to hi (inclusive) whose `length` bytes have the anchor at place.

    A window's anchor is its substring of `gram` bytes (a power of two) with the least hash, the leftmost of equals;
    it depends on the window's bytes alone, so equal windows have equal anchors at equal places.
    """
    n = len(data) - length + 1
    los, his, fps, places = [], [], [], []
    width = length - gram + 1
    for at in range(0, max(n, 0), CHUNK):
        starts = min(CHUNK, n - at)
        h = _TABLE[data[at : at + starts + length - 1]]
        step, reach = _STEP, 1
        while reach < gram:
            h = h[:-reach] * np.uint64(step) + h[reach:]
            step, reach = step * step & (1 << 64) - 1, 2 * reach
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        low = np.uint64((1 << 24) - 1)
        v = (mixed & ~low) | np.arange(len(h), dtype=np.uint64)
        pad = np.full(-len(v) % width, ~np.uint64(0))
        block = np.concatenate([v, pad]).reshape(-1, width)
        front = np.minimum.accumulate(block, axis=1).ravel()
        back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(back[:starts], front[width - 1 : width - 1 + starts]) & low).astype(np.int64)
        lo = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        los.append(lo + at)
        his.append(np.r_[lo[1:] - 1, starts - 1] + at)
        fps.append(h[place[lo]].view(np.int64))
        places.append(place[lo] + at)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (los, his, fps, places))


class RunLengthIndex:
    """The Burrows-Wheeler transform of some strings, run-length compressed, with the suffix array sampled at run ends.

    Per run only its character and length, the text positions of its first and last row, and the length of their common
    prefix with the row before and after the run are kept. That is enough to stream every position's longest match
    elsewhere: unless a position's row begins a run, its match with the row above is that of the position before it,
    less one character; likewise for run ends and the row below.
    """

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.text = np.frombuffer(b"".join(strings), np.uint8)
        n = len(self.text)
        self.end = np.repeat(self.begin + sizes, sizes)
        order = self._sorted()
        first = np.zeros(n, bool)
        first[self.begin[sizes > 0]] = True
        before = np.where(first[order], -1 - order, self.text[order - 1].astype(np.int64))  # string starts: a sentinel of their own
        change = before[1:] != before[:-1]
        head, tail = np.flatnonzero(np.r_[True, change][:n]), np.flatnonzero(np.r_[change, True][:n])
        self.run_char, self.run_length = before[head], tail - head + 1
        self.head_at, self.tail_at = order[head], order[tail]
        self.head_match = np.r_[0, self._common(order[head[1:] - 1], order[head[1:]])] if len(head) else head
        self.tail_match = np.r_[self._common(order[tail[:-1]], order[tail[:-1] + 1]), 0] if len(tail) else tail

    def _sorted(self) -> np.ndarray:
        """The suffix array, by prefix doubling; a suffix ends with its string, equal ones stay in text order."""
        n = len(self.text)
        left = self.end - np.arange(n)
        padded = np.r_[self.text.astype(np.int64) + 1, np.zeros(7, np.int64)]
        key = np.zeros(n, np.int64)
        for i in range(7):
            key = key << 9 | np.where(left > i, padded[i : i + n], 0)
        order = np.argsort(key, kind="stable")
        new = np.r_[True, key[order[1:]] != key[order[:-1]]][:n]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        depth = 7
        where = np.arange(n)  # rows of order that aren't settled
        longest = int(left.max(initial=0))
        while depth < longest and len(where):
            r = rank[order[where]]
            alone = np.r_[True, r[1:] != r[:-1]] & np.r_[r[1:] != r[:-1], True]
            where = where[~alone]
            if not len(where):
                break
            at = order[where]
            beyond = left[at] <= depth
            second = np.where(beyond, 0, rank[np.minimum(at + depth, n - 1)] + 1)
            key = rank[at] * (n + 1) + second
            o = np.argsort(key, kind="stable")
            at, key = at[o], key[o]
            order[where] = at
            new = np.r_[True, key[1:] != key[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            rank[at] = where[start]
            depth *= 2
        return order

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b."""
        most = np.minimum(self.end[a] - a, self.end[b] - b)
        words = np.lib.stride_tricks.sliding_window_view(np.r_[self.text, np.zeros(8, np.uint8)], 8)
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            equal = words[x] == words[y]
            step = np.where(equal.all(axis=1), 8, np.argmin(equal, axis=1))
            out[live] += step
            live = live[(step == 8) & (out[live] < most[live])]
        return np.minimum(out, most)

    def matches(self) -> np.ndarray:
        """For every position the length of its longest match elsewhere, streamed from the samples in text order."""
        n = len(self.text)
        best = np.zeros(n, np.int64)
        for at, match in ((self.head_at, self.head_match), (self.tail_at, self.tail_match)):
            sample = np.full(n, -1, np.int64)
            sample[at] = match
            source = np.maximum.accumulate(np.where(sample >= 0, np.arange(n), 0))
            best = np.maximum(best, sample[source] - (np.arange(n) - source))
        return best


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true values."""
    edge = np.diff(np.r_[0, mask.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


DOC_SCHEMA = "rid long, doc_id long, n_bytes long, sha binary, mlo array<int>, mhi array<int>, lo array<int>, hi array<int>, place array<int>, fp array<long>, sh array<long>, n array<int>"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int32())] * 5, *[pa.list_(pa.int64())] * 2, pa.list_(pa.int32())]


def _surveyed(length: int, gram: int):
    """Per document: its snippets (window starts with one anchor, by anchor and by hash of their text), each kind once.

    A snippet that occurs again in its own document is marked at once at all its places.
    """
    names = ["rid", "doc_id", "n_bytes", "sha", "mlo", "mhi", "lo", "hi", "place", "fp", "sh", "n"]

    def of(rid: int, doc_id: int | None, text: bytes) -> tuple:
        lo, hi, fp, place = anchors(np.frombuffer(text, np.uint8), length, gram)
        digest = xxhash.xxh3_64_intdigest
        sh = np.fromiter((digest(text[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist())), np.uint64, len(lo)).view(np.int64)
        order = np.lexsort((lo, sh, fp))
        new = np.r_[True, (fp[order[1:]] != fp[order[:-1]]) | (sh[order[1:]] != sh[order[:-1]])][: len(order)]
        at = np.flatnonzero(new)
        count = np.diff(np.r_[at, len(order)])
        again = order[np.repeat(count, count) > 1]
        again.sort()
        keep = order[at]
        return rid, doc_id, len(text), hashlib.sha256(text).digest(), lo[again], hi[again], lo[keep], hi[keep], place[keep], fp[keep], sh[keep], count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for r, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                t = (t.as_py() or "").encode("utf-8", "surrogatepass")
                held.append(of(r, d, t))
                size += len(t)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), _KINDS)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), _KINDS)], names)

    return run


INDEXED = "rid long, lo long, hi long, fp long, cell int, core long, h array<long>, open array<boolean>"


def _indexed(length: int):
    """Marks the repeated window starts of snippets (group, rid, lo, place, alone, split, fp, snippet), met by group.

    Emits (rid, lo, hi): marked starts of snippets that occur once (alone). For split anchors, whose snippets meet in
    several indexes, also what other indexes must know: per snippet and cell, CELL window starts at fixed places before
    the anchor, a hash of the bytes that all windows of the cell share (core), a hash of each window, and which windows
    still lack a match (open). Cells without open windows are needed once per index only.
    """
    names = ["rid", "lo", "hi", "fp", "cell", "core", "h", "open"]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
    digest = lambda x: xxhash.xxh3_64_intdigest(x) - (1 << 63)

    def cells(rid: int, lo: int, place: int, alone: bool, fp: int, text: bytes, hit: np.ndarray) -> Iterator[tuple]:
        n = len(hit)
        for cell in range((place - lo - n + 1) // CELL, (place - lo) // CELL + 1):
            last = place - cell * CELL - lo  # the cell's starts are last - CELL + 1 to last, as far as the snippet has them
            a, b = max(0, last - CELL + 1), min(n - 1, last)
            core = text[last : last - CELL + 1 + length]
            yield rid, lo + a, None, fp, cell, digest(core), [digest(text[i : i + length]) for i in range(a, b + 1)], [alone and not m for m in hit[a : b + 1].tolist()]

    def marked(rows: list[tuple]) -> pa.RecordBatch:
        index = RunLengthIndex([r[6] for r in rows])
        long = index.matches() >= length
        out: list[tuple] = []
        seen: set[tuple] = set()
        for (rid, lo, place, alone, split, fp, text), at in zip(rows, index.begin.tolist()):
            hit = long[at : at + len(text) - length + 1]
            if alone:
                out += [(rid, lo + a, lo + b, None, None, None, None, None) for a, b in zip(*(x.tolist() for x in _runs(hit)))]
            for c in cells(rid, lo, place, alone, fp, text, hit) if split else ():
                known = (c[3], c[4], *c[6])
                if any(c[7]) or known not in seen:
                    out.append(c)
                    seen.add(known)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [()] * 8, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, group = [], 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != group and size >= INDEX_BYTES:
                    yield marked(held)
                    held, size = [], 0
                    trim()
                group = row[0]
                held.append(row[1:])
                size += len(row[7])
        if held:
            yield marked(held)
        held = []
        trim()

    return run


def _merged(length: int):
    """(rid, starts as arrays a, b) with intervals joined whose windows cover bytes that overlap or adjoin: the same bytes
    are covered, by one interval for each run of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            los, his = [], []
            for a, b in zip(batch.column(1), batch.column(2)):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                order = np.argsort(a, kind="stable")
                a, reach = a[order], np.maximum.accumulate(b[order])
                new = np.flatnonzero(np.r_[True, a[1:] > reach[:-1] + length])
                los.append(a[new])
                his.append(reach[np.r_[new[1:] - 1, len(a) - 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in (los, his))], ["rid", "a", "b"])

    return run


def _stripped(length: int):
    """(doc_id, text, starts as arrays a, b) to the result: the bytes under marked windows go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, a, b in zip(*batch.columns):  # texts are looked at where they lie
                doc_id, text = doc_id.as_py(), np.frombuffer(text.as_buffer(), np.uint8)
                a, b = a.values.to_numpy(), b.values.to_numpy().astype(np.int64) + length
                cover = np.zeros(len(text) + 1, np.int32)
                np.add.at(cover, a, 1)
                np.add.at(cover, np.minimum(b, len(text)), -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept = text[~gone].tobytes()
                rows.append((doc_id, len(text), len(text) - len(kept), len(_runs(gone)[0]), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _met(texts: DataFrame, rows: DataFrame, on: str, intervals: str | None = None) -> DataFrame:
    """texts joined with rows: broadcast up to a checked count of rows and of their intervals, by a shuffle beyond."""
    n, held = rows.agg(F.count("*"), F.coalesce(F.sum(F.size(intervals)) if intervals else F.lit(0), F.lit(0))).first()
    return texts.join(F.broadcast(rows) if n <= BROADCAST_ROWS and held <= BROADCAST_INTERVALS else rows, on)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of its text's UTF-8 bytes.

    Every byte under a window of `length` bytes that also starts elsewhere, in this or another document, goes. Null
    texts are empty; texts shorter than `length` keep all; rows that repeat a doc_id are documents of their own.

    1. Each document is cut into snippets: the windows that share an anchor. Equal windows have equal anchors.
    2. Snippets are counted by (anchor, text hash), with map-side sums. Snippets that occur twice are repeated wholly;
       anchors with one snippet need nothing more.
    3. One copy each of the different snippets of an anchor meet in an index (RunLengthIndex), which marks the windows
       that match elsewhere. Anchors with very many snippets are split over several indexes; what these leave unmarked
       is compared across them: first by the bytes that CELL neighbouring windows share, then window by window where
       those occur again, each time with sums.
    """
    return settled("substring-kept", docs.sparkSession, lambda: _remove_repeats(docs, length, gram))


def _remove_repeats(docs: DataFrame, length: int, gram: int) -> DataFrame:
    spark = docs.sparkSession
    rows = numbered(docs, "doc_id", "text").withColumnRenamed("row", "rid")
    texts = rows.select("rid", "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))  # read again where they are needed, without a copy
    base = staged(rows.mapInArrow(_surveyed(length, gram), DOC_SCHEMA), "substring")
    every = base.select("rid", F.inline(F.arrays_zip("lo", "hi", "place", "fp", "sh", "n")))
    kinds = every.groupBy("fp", "sh").agg(F.sum("n").alias("c"), F.min("rid").alias("r"))
    of_anchor = kinds.groupBy("fp").agg(F.count("*").alias("d"), F.sum("c").alias("all")).where(F.col("all") > 1).select("fp", "d")
    wanted = staged(kinds.join(of_anchor, "fp"), "substring-kinds")
    found = staged(every.join(wanted, ["fp", "sh"]).where((F.col("c") > 1) | (F.col("d") > 1)), "substring-found")
    need = found.where((F.col("d") > 1) & (F.col("rid") == F.col("r")))
    # A split anchor's snippets are dealt by their text hash, about half of ANCHOR_SNIPPETS to each index.
    shares = F.greatest(F.lit(1), F.ceil(2 * F.col("d") / ANCHOR_SNIPPETS)).cast("long")
    split = F.col("d") > ANCHOR_SNIPPETS
    group = F.xxhash64("fp", F.when(split, F.pmod(F.xxhash64("sh"), shares)).otherwise(F.lit(0)))
    need = staged(need.select("rid", "lo", "hi", "place", group.alias("group"), (F.col("c") == 1).alias("alone"), split.alias("split"), "fp"), "substring-need")
    snippets = _met(texts.select("rid", "text"), need, "rid").select("group", "rid", F.col("lo").cast("long").alias("lo"), F.col("place").cast("long").alias("place"), "alone", "split", "fp", F.expr(f"substring(text, lo + 1, hi - lo + {length})").alias("snippet"))
    dealt = snippets.repartition(shuffle_partitions(spark), "group").sortWithinPartitions("group")
    indexed = staged(dealt.mapInArrow(_indexed(length), INDEXED), "substring-indexed")
    cells = indexed.where("cell IS NOT NULL")
    shared = cells.groupBy("fp", "cell", "core").agg(F.count("*").alias("k")).where("k > 1").select("fp", "cell", "core")
    likely = cells.join(shared, ["fp", "cell", "core"], "left_semi").select("rid", "lo", "fp", F.posexplode(F.arrays_zip("h", "open")))
    windows = likely.select("rid", (F.col("lo") + F.col("pos")).alias("lo"), "fp", "col.h", "col.open")
    twice = windows.groupBy("fp", "h").agg(F.count("*").alias("k")).where("k > 1").select("fp", "h")
    late = windows.where("open").join(twice, ["fp", "h"]).select("rid", "lo", F.col("lo").alias("hi"))
    marks = found.where("c > 1").select("rid", "lo", "hi").union(indexed.where("cell IS NULL").select("rid", "lo", "hi")).union(late)
    marks = marks.union(base.select("rid", F.inline(F.arrays_zip("mlo", "mhi")))).select("rid", F.struct(F.col("lo").cast("int").alias("a"), F.col("hi").cast("int").alias("b")).alias("m"))
    collected = marks.groupBy("rid").agg(F.collect_list("m").alias("m")).select("rid", F.col("m.a").alias("a"), F.col("m.b").alias("b"))
    per_doc = staged(collected.mapInArrow(_merged(length), "rid long, a array<int>, b array<int>"), "substring-marks")
    stripped = _met(texts, per_doc, "rid", "a").select("doc_id", "text", "a", "b").mapInArrow(_stripped(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    ids = per_doc.select("rid")
    whole = base.select("rid", "doc_id", "n_bytes", "sha").join(ids, "rid", "left_anti")
    return stripped.union(whole.select("doc_id", "n_bytes", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lower(F.hex("sha"))))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats over the whole table of documents; see there for nulls, repeats and short texts."""
    return remove_repeats(table(spark, sf_dir, "documents"))
