"""SimHash near duplicates (10): fingerprints of word shingles, linked through pivot distance tables."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import release_caches
from .shared import components, numbered, only, settled, shuffle_partitions, staged, table

SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Bit blocks of a fingerprint; links of d bits leave all but d of them alike.
BLOCKS = 6
#: Number of reference fingerprints.
PIVOTS = 16
#: Runs of fingerprints with equal key up to this length are compared by offset, longer ones by probing.
SHORT_RUN = 128
#: For similarities rather than a few bits: the fingerprint's width, and the standard deviations beyond the expected
#: distance from which a pair is no candidate (at 6, fewer than one in ten million pairs at the similarity itself).
WIDTH, DEVIATIONS = 256, 6.0
#: Shingles counted at once by a task, the count over all texts from which a shingle can be known as frequent, and how many
#: such are kept. They only order shingles: results are the same whatever is found.
COUNTED, LEAST_FREQUENT, MOST_FREQUENT = 4_000_000, 8, 200_000
#: Rows of one or two longs that are broadcast at most.
BROADCAST_ROWS = 500_000
#: From this count on, texts with a shingle aren't paired by it in one task but are candidates of each other as a whole.
HOT_SHINGLE = 20_000
#: Texts, and shingles in them, that are compared within one task. Larger groups of candidates are probed by rounds.
TOGETHER, TOGETHER_SHINGLES = 4096, 4_000_000
#: Texts of such a group that meet its probes in one task, and probes of the first round and of later ones.
PROBED_TEXTS, FIRST_PROBES, PROBES = 8192, 16, 512


def _hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """The hashes of the text's word shingles, CHUNK at a time. A-Z are lower-cased."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    n = len(tokens)
    if not n:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = max(1, n - words + 1)
    stops = ends[words - 1 :] if n >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, k, CHUNK):
        i, j = starts[at : min(k, at + CHUNK)].tolist(), stops[at : at + CHUNK].tolist()
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(i, j)), np.uint64, len(i))


def _ones(h: np.ndarray, width: int) -> np.ndarray:
    """For each of width bits in how many of the hashes it is set.

    Bits beyond the first 64 come from the same hash, mixed anew for every 64.
    """
    ones = np.zeros(width, np.int64)
    for w in range(0, width, 64):
        octets = (_mixed(h, w // 64) if w else h).view(np.uint8).reshape(-1, 8)
        if len(h) > 512:
            for o in range(8):
                ones[w + 8 * o : w + 8 * o + 8] += np.bincount(octets[:, o], minlength=256) @ _OCTET_BITS
        else:
            ones[w : w + 64] += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return ones


def shingle_counts(text: str | None, words: int, width: int = 64) -> tuple[int, np.ndarray]:
    """The number of the text's word shingles, and for each of width bits in how many of their hashes it is set."""
    k, ones = 0, np.zeros(width, np.int64)
    for h in _hashes(text, words):
        k += len(h)
        ones += _ones(h, width)
    return k, ones


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of the text's word shingles, ascending."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_hashes(text, words)]))


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    z = h + np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, words: int, width: int = 64) -> np.ndarray:
    """The SimHash of the text's word shingles as 64-bit words; a bit is set if over half the hashes have it."""
    k, ones = shingle_counts(text, words, width)
    return np.packbits(ones * 2 > k, bitorder="little").view("<u8")


_OCTET_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _columns(width: int) -> list[str]:
    return [f"f{i}" for i in range(width // 64)]


def _fingerprints(words: int, width: int):
    names = ["doc_id", *_columns(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words, width) for t in b.column(1)], np.uint64).reshape(-1, width // 64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in fp.T)], names)

    return run


def block_masks(blocks: int = BLOCKS) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def references(pivots: int = PIVOTS, width: int = 64) -> np.ndarray:
    """The reference fingerprints: fixed, spread over the cube (hashes of 0, 1, ...)."""
    n = width // 64
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(pivots * n)], np.uint64).reshape(pivots, n)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference, one row per reference."""
    return np.stack([distance(fps, p) for p in pivots]) if len(pivots) else np.zeros((0, len(fps)), np.int16)


class _Forest:
    """Union-find over the positions of an array."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs first connect two parts."""
        new = np.zeros(len(a), bool)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
            i, j = self.find(i), self.find(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)
                new[k] = True
        return new


def _survivors(fps: np.ndarray, coords: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs pass the pivot table (no coordinate differs by more than bits) and then the true distance."""
    alive = np.arange(len(a))
    for row in coords:
        alive = alive[np.abs(row[a[alive]] - row[b[alive]]) <= bits]
    return alive[distance(fps[a[alive]], fps[b[alive]]) <= bits]


def _probe(fps: np.ndarray, coords: np.ndarray, lo: int, hi: int, free: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within bits in the sorted run fps[lo:hi], whose members differ only in the free mask's bits.

    Every way to flip up to bits of the free bits is looked up by binary search: the work follows the run's length.
    """
    part = fps[lo:hi, 0]
    positions = [1 << i for i in range(64) if free >> i & 1]
    for m in range(1, bits + 1):
        for flip in combinations(positions, m):
            mate = part ^ np.uint64(sum(flip))
            at = np.searchsorted(part, mate)
            at[at == len(part)] = 0
            hit = np.flatnonzero((part[at] == mate) & (at > np.arange(len(part))))
            if len(hit):
                keep = _survivors(fps, coords, hit + lo, at[hit] + lo, bits)
                yield hit[keep] + lo, at[hit][keep] + lo


def _led(fps: np.ndarray, lo: int, hi: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever is connected within bits in the run fps[lo:hi], for runs of many near copies.

    The first fingerprint not yet reached becomes a pivot and links all within bits; pairs of different pivots' groups
    are then compared, blocks of rows against all later ones, and one link for each two groups comes out of a block.
    """
    left = np.arange(lo, hi)
    groups: list[np.ndarray] = []
    while len(left):
        near = distance(fps[left], fps[left[0]]) <= bits
        groups.append(left[near])
        yield np.full(int(near.sum()) - 1, left[0]), left[near][1:]
        left = left[~near]
    rows = np.concatenate(groups)
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    ends = np.cumsum([len(g) for g in groups])
    for at in range(0, len(rows), 64):
        block, later = rows[at : at + 64], int(ends[group[at]])
        for k in range(later, len(rows), 1 << 16):
            other = rows[k : k + (1 << 16)]
            apart = np.zeros((len(block), len(other)), np.int16)
            for w in range(fps.shape[1]):
                apart += np.bitwise_count(fps[block, w][:, None] ^ fps[other, w][None, :])
            x, y = np.nonzero((apart <= bits) & (group[at : at + 64, None] < group[None, k : k + (1 << 16)]))
            _, first = np.unique(group[at + x] * len(groups) + group[k + y], return_index=True)
            yield block[x[first]], other[y[first]]


def _linked(bits: int, width: int, pivots: int, free: list[int] | None):
    """Links within runs of equal (t, key). free: for each t the bits in which a run's members can differ, if few."""
    refs, short = references(pivots, width), SHORT_RUN

    def links(t: np.ndarray, key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """Whole runs, sorted by t, key and (64-bit fingerprints) value."""
        coords = pivot_table(fp, refs)
        n = len(fp)
        new = np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])]
        start = np.flatnonzero(new)
        length = np.diff(np.r_[start, n])
        run = np.cumsum(new) - 1
        stop = (start + length)[run]
        brief = length[run] <= short
        forest, out = _Forest(n), []
        longest = int(length[length <= short].max(initial=0))
        for s in range(1, longest):
            a = np.flatnonzero(brief & (np.arange(n) + s < stop))
            if not len(a):
                break
            a = a[_survivors(fp, coords, a, a + s, bits)]
            first = forest.join(a, a + s)
            out.append((a[first], a[first] + s))
        for lo, many in zip(start[length > short].tolist(), length[length > short].tolist()):
            for a, b in _probe(fp, coords, lo, lo + many, free[int(t[lo])], bits) if free else _led(fp, lo, lo + many, bits):
                first = forest.join(a, b)
                out.append((a[first], b[first]))
        a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    def whole(parts: list[np.ndarray]) -> tuple:
        t, key, node, *fp = parts
        fp = np.stack(fp, axis=1).view(np.uint64)
        if free:  # rows come sorted by (t, key); binary search needs the values in unsigned order within a run
            order = np.lexsort((fp[:, 0], key, t))
            t, key, node, fp = t[order], key[order], node[order], fp[order]
        same = (t[1:] == t[:-1]) & (key[1:] == key[:-1])
        met = np.r_[False, same] | np.r_[same, False]  # what is alone with its key links to nothing
        return t[met], key[met], node[met], fp[met]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            rows += batch.num_rows
            if rows < 200_000 or (held[0][0][0] == held[-1][0][-1] and held[0][1][0] == held[-1][1][-1]):
                continue
            parts = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.flatnonzero((parts[0] != parts[0][-1]) | (parts[1] != parts[1][-1]))[-1]) + 1
            yield links(*whole([p[:cut] for p in parts]))
            held, rows = [tuple(p[cut:] for p in parts)], len(parts[0]) - cut
        if rows:
            yield links(*whole([np.concatenate(x) for x in zip(*held)]))

    return run


def _met(rows: DataFrame, run) -> DataFrame:
    """rows: (t, key, node, f0, ...). Runs of equal (t, key) meet whole."""
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInArrow(run, "a long, b long")


def near_links(nodes: DataFrame, bits: int = 2, blocks: int = BLOCKS, pivots: int = PIVOTS) -> DataFrame:
    """Pairs (a, b) of nodes whose 64-bit fingerprints (node, f0) lie within the distance: a spanning forest per bucket.

    Two values within `bits` agree on all but `bits` of the blocks, so they meet in the bucket of some combination of
    blocks. A bucket holds only values that differ in the free blocks' bits (22 for 2 of 6), which bounds it; within
    it, distances to the reference fingerprints are tabulated, pairs are discarded by their maximum coordinate
    difference, survivors are verified, and only links that connect something new are returned: every value stays
    connected to all that it reaches.
    """
    masks = block_masks(blocks)
    tables = list(combinations(range(blocks), blocks - bits))
    fixed = [sum(masks[i] for i in t) for t in tables]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("f0").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(fixed)])
    rows = nodes.select(F.explode(keys).alias("k"), "node", "f0").select("k.t", "k.key", "node", "f0")
    return _met(rows, _linked(bits, 64, pivots, [((1 << 64) - 1) ^ m for m in fixed]))


def radius(similarity: float, width: int) -> int:
    """Differing bits of width up to which texts are candidates for such a Jaccard similarity of their shingle sets.

    At similarity s of sets of equal size (others are nearer) bits differ independently with p = arccos(2s / (1 + s)) / pi.
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(np.ceil(width * p + DEVIATIONS * (width * p * (1 - p)) ** 0.5))


def _digests(words: int):
    """Of each text (row, doc_id, text): its shingle set's digest and size; and (h, c): shingles met in c texts of a task.

    A task drops shingles that it has met once only, so that rare ones cost nothing.
    """
    names = ["row", "doc_id", "d0", "d1", "n", "h", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            h, c = h[c > 1], c[c > 1]
            return pa.RecordBatch.from_arrays([*[pa.nulls(len(h), pa.int64())] * 5, pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names)

        for b in batches:
            digests, sizes = [], []
            for t in b.column(2):
                h = shingle_set(t.as_py(), words)
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes(), SEED), "<i8"))
                sizes.append(len(h))
                held.append(h)
                n += len(h)
                if n >= COUNTED:
                    yield counted()
                    held, n = [], 0
            digest = np.array(digests, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(d)) for d in digest.T), pa.array(sizes, pa.int64()), *[pa.nulls(len(sizes), pa.int64())] * 2], names)
        yield counted()

    return run


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, and their counts, from (h, c) of all tasks."""
    top = counts.groupBy("h").agg(F.sum("c").alias("n")).where(F.col("n") >= LEAST_FREQUENT)
    top = top.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect()
    found = np.array([(r["h"], r["n"]) for r in top], np.int64).reshape(-1, 2)
    h, n = found[:, 0].copy().view(np.uint64), found[:, 1]
    order = np.argsort(h)
    return h[order], n[order]


def _sketches(words: int, similarity: float, width: int, frequent: tuple[np.ndarray, np.ndarray]):
    """Of each text (row, text): its shingle set's size, fingerprint and its first shingles, the more frequent ones coming last.

    Sets of similarity s share at least s of either set, so that they share one of the first n - ceil(s n) + 1 of n
    shingles in any order that is the same for all sets. Those among them that are hot come apart.
    """
    names = ["node", "n", *_columns(width), "first", "hot"]
    (known, counts), hottest = frequent, HOT_SHINGLE
    levels = np.floor(np.log2(counts)).astype(np.int64) if len(counts) else counts

    def lists(parts: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(p.view(np.int64) for p in parts)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for b in batches:
            fps, firsts, hots, sizes = [], [], [], []
            for t in b.column(1):
                h = shingle_set(t.as_py(), words)
                sizes.append(len(h))
                fps.append(np.packbits(_ones(h, width) * 2 > len(h), bitorder="little").view("<u8"))
                keep = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
                hot = np.zeros(0, np.uint64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    there = known[at] == h
                    order = np.argsort(np.where(there, levels[at], 0), kind="stable")[:keep]
                    heat = np.where(there, counts[at], 0)[order] >= hottest
                    h, hot = h[order][~heat], h[order][heat]
                firsts.append(h[:keep])
                hots.append(hot)
            fp = np.array(fps, np.uint64).reshape(-1, width // 64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in fp.T.view(np.int64)), lists(firsts), lists(hots)], names)

    return run


def _hot_links(prints: DataFrame) -> DataFrame:
    """(a, b) that connect all texts with a hot shingle among their first ones: few shingles, each counted by partial sums."""
    hot = prints.where(F.size("hot") > 0)
    pairs = hot.select(F.col("hot")[0].alias("a"), F.explode("hot").alias("b")).distinct()
    groups = components(pairs).select(F.col("node").alias("h"), F.col("component").alias("g")).union(pairs.where("a = b").select(F.col("a").alias("h"), F.col("a").alias("g"))).groupBy("h").agg(F.min("g").alias("g"))
    named = hot.select("node", F.col("hot")[0].alias("h")).join(F.broadcast(groups), "h")  # at most MOST_FREQUENT shingles
    return named.join(F.broadcast(named.groupBy("g").agg(F.min("node").alias("least"))), "g").select(F.col("least").alias("a"), F.col("node").alias("b"))


def _alike(sets: list[np.ndarray], similarity: float, width: int) -> np.ndarray:
    """For each set the position of the first one that it reaches by links of exact Jaccard similarity or more.

    What a group has not reached yet is compared with each of its members in turn: many near copies take few rounds.
    """
    root = np.arange(len(sets))
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    fps = np.stack([np.packbits(_ones(h, width) * 2 > len(h), bitorder="little").view("<u8") for h in sets])
    bits = radius(similarity, width)
    left = np.arange(len(sets))
    while len(left):
        first, left, queue = left[0], left[1:], [left[0]]
        while queue and len(left):
            x = queue.pop()
            fits = np.minimum(size[left], size[x]) >= similarity * np.maximum(size[left], size[x]) - 1e-9
            near = np.flatnonzero(fits & (distance(fps[left], fps[x]) <= bits))
            hit = []
            for at in range(0, len(near), 256):
                part = near[at : at + 256]
                flat = np.concatenate([sets[i] for i in left[part]])
                found = np.r_[0, np.cumsum(sets[x][np.minimum(np.searchsorted(sets[x], flat), size[x] - 1)] == flat)]
                ends = np.r_[0, np.cumsum(size[left[part]])]
                both = found[ends[1:]] - found[ends[:-1]]
                hit.append(part[both >= similarity * (size[left[part]] + size[x] - both) - 1e-9])
            new = np.concatenate([np.zeros(0, np.int64), *hit])
            root[left[new]] = first
            queue += left[new].tolist()
            left = np.delete(left, new)
    return root


def _both(x: np.ndarray, y: np.ndarray) -> int:
    """The number of values that two ascending arrays share."""
    x, y = (x, y) if len(x) < len(y) else (y, x)
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def _verified(words: int, similarity: float, width: int):
    """(node, root) from (component, node, text), met whole by component: root names what is linked by exact similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        now, nodes, sets = None, [], []

        def settled() -> pa.RecordBatch:
            names = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[_alike(sets, similarity, width)])], ["node", "root"])

        for b in batches:
            for component, node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if component != now and nodes:
                    yield settled()
                    nodes, sets = [], []
                now = component
                nodes.append(node)
                sets.append(shingle_set(text.as_py(), words))
        if nodes:
            yield settled()

    return run


def _probe_links(words: int, similarity: float, width: int):
    """(a, b): parts that an exact link connects, from (group, share, kind, node, part, text, f0, ...), in that order.

    Of each group and share the probes (kind 0) come first and are held; the other texts pass by one by one. A text
    gives one link at most for each part among the probes.
    """
    bits = radius(similarity, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        now, parts, sets, prints = None, [], [], []
        for b in batches:
            found = set()
            fps = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[6:]], axis=1).view(np.uint64)
            for i, (group, share, kind, part) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)))):
                if (group, share) != now:
                    now, parts, sets, prints = (group, share), [], [], []
                x = shingle_set(b.column(5)[i].as_py(), words)
                if kind == 0:
                    parts.append(part)
                    sets.append(x)
                    prints.append(fps[i].copy())
                    continue
                if isinstance(prints, list):
                    prints, sizes, names = np.array(prints, np.uint64).reshape(-1, width // 64), np.array([len(y) for y in sets]), np.array(parts, np.int64)
                fits = (np.minimum(sizes, len(x)) >= similarity * np.maximum(sizes, len(x)) - 1e-9) & (names != part)
                linked = set()
                for k in np.flatnonzero(fits & (distance(prints, fps[i]) <= bits)).tolist():
                    if parts[k] in linked:
                        continue
                    both = _both(sets[k], x)
                    if both >= similarity * (len(sets[k]) + len(x) - both) - 1e-9:
                        linked.add(parts[k])
                found |= {(p, part) for p in linked}
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _probed(held: DataFrame, words: int, similarity: float, width: int) -> DataFrame:
    """(node, root) from (component, node, n, text, f0, ...) for groups of any size: what exact links connect, by rounds.

    A round compares some texts of each group, the probes, with all others of it, which are dealt over many tasks, and
    joins the parts that links connect. It ends when whatever isn't in a group's largest part has been a probe: any
    link that is left then lies within that part. Copies of one text thus take a few probes, whatever their number.
    """
    spark, cols = held.sparkSession, _columns(width)
    sizes = held.groupBy("component").agg(F.ceil(F.count("*") / F.lit(PROBED_TEXTS)).cast("int").alias("shares"))
    base = staged(held.join(sizes, "component").withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")), "similar-large")
    state = staged(base.select("component", "node", "n", F.col("node").alias("part"), F.lit(False).alias("probed")), "similar-parts")
    probes = FIRST_PROBES
    for turn in itertools.count():
        parts = state.groupBy("component", "part").agg(F.count("*").alias("c"))
        largest = parts.groupBy("component").agg(F.max(F.struct("c", "part"))["part"].alias("largest"))
        todo = state.join(largest, "component").where("NOT probed AND part <> largest")
        each = todo.groupBy("component").agg(F.count("*").alias("u"), F.avg("n").alias("mean"))
        each = each.select("component", F.ceil(F.col("u") / F.greatest(F.lit(1), F.least(F.lit(probes), F.floor(TOGETHER_SHINGLES / F.greatest(F.col("mean"), F.lit(1)))))).alias("every"))
        chosen = staged(todo.join(each, "component").where(F.pmod(F.xxhash64("node", F.lit(turn)), F.col("every")) == 0).select("node", F.col("part").alias("p")), "similar-probes")
        if not todo.limit(1).count():
            return state.select("node", F.col("part").alias("root"))
        ahead = base.join(chosen, "node").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        ahead = ahead.select("component", "share", F.lit(0).alias("kind"), "node", F.col("p").alias("part"), "text", *cols)
        every = base.join(state.select("node", "part"), "node").select("component", "share", F.lit(1).alias("kind"), "node", "part", "text", *cols)
        dealt = ahead.union(every).repartition(shuffle_partitions(spark), "component", "share").sortWithinPartitions("component", "share", "kind")
        links = staged(dealt.mapInArrow(_probe_links(words, similarity, width), "a long, b long").distinct(), "similar-links")
        joined = components(links).select(F.col("node").alias("part"), F.col("component").alias("joined"))
        new = state.join(joined, "part", "left").join(chosen.select("node", F.lit(True).alias("now")), "node", "left")
        state = staged(new.select("component", "node", "n", F.coalesce("joined", "part").alias("part"), (F.col("probed") | F.coalesce("now", F.lit(False))).alias("probed")), "similar-parts")
        probes = PROBES


def _small(rows: DataFrame) -> DataFrame:
    """rows of a few longs, to be broadcast if they are BROADCAST_ROWS at most."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _grouped(prints: DataFrame, links) -> DataFrame:
    """prints with component_id: the smallest doc_id reachable. links: from distinct (node, f0) to pairs of nodes."""
    cols = _columns(64)
    distinct = prints.groupBy(*cols).agg(F.min("doc_id").alias("least"))
    nodes = staged(distinct.withColumn("node", F.col("f0")), "simhash-nodes")
    reach = components(links(nodes.select("node", *cols)).distinct()).withColumnRenamed("node", "n")
    linked = nodes.join(reach, F.col("node") == F.col("n")).select(*cols, "component", "least")
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    member = linked.select(*cols, "component").join(named, "component").select(*cols, "component_id")
    whole = nodes.join(member, cols, "left").select(*cols, F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(whole, cols)


def simhash_dedup(docs: DataFrame, words: int = 3, bits: int = 2, blocks: int = BLOCKS, pivots: int = PIVOTS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id.

    component_id is the smallest doc_id that is reachable by links of `bits` or fewer differing bits. A text of fewer
    words than a shingle is one shingle; one without words, empty or null has fingerprint zero and links like any other.
    Null doc_ids don't name a component unless it has no other. Equal fingerprints are one node, so copies cost nothing.
    """
    def grouped() -> DataFrame:
        prints = staged(only(docs, "doc_id", "text").mapInArrow(_fingerprints(words, 64), "doc_id long, f0 long"), "simhash")
        return _grouped(prints, lambda nodes: near_links(nodes, bits, blocks, pivots))

    out = settled("simhash-groups", docs.sparkSession, grouped)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def similar_rows(texts: DataFrame, words: int = 5, similarity: float = 0.8, width: int = WIDTH, pivots: int = PIVOTS) -> DataFrame:
    """row, doc_id, group, component_id from (row, doc_id, text), row unique and not null: texts grouped by links of Jaccard similarity or more between their sets of word shingles.

    Candidates share one of their first shingles (which sets so similar always do) and have fingerprints of `width` bits
    within radius(similarity, width); only links that the sets themselves confirm count. Equal sets are one node; texts
    without words are alike. A group is named by its smallest row of a node, and component_id as in simhash_dedup.
    What candidates connect is compared in one task up to TOGETHER texts, by rounds of probes over many tasks beyond.
    """
    texts = only(texts, "row", "doc_id", "text")
    return settled("similar-groups", texts.sparkSession, lambda: _similar_rows(texts, words, similarity, width, pivots))


def _similar_rows(texts: DataFrame, words: int, similarity: float, width: int, pivots: int) -> DataFrame:
    cols = _columns(width)
    made = staged(texts.mapInArrow(_digests(words), "row long, doc_id long, d0 long, d1 long, n long, h long, c long"), "similar-sets")
    sets = made.where("row IS NOT NULL").select("row", "doc_id", "d0", "d1")
    nodes = staged(sets.groupBy("d0", "d1").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "similar-nodes")
    frequent = _frequent(made.where("h IS NOT NULL"))
    schema = "node long, n long, " + ", ".join(f"{c} long" for c in cols) + ", first array<long>, hot array<long>"
    # Texts with equal sets are one node; which rows those are is broadcast up to a count, and joined by a shuffle beyond.
    every = texts.select("row", "text").mapInArrow(_sketches(words, similarity, width, frequent), schema)
    prints = staged(every.join(_small(nodes.select("node")), "node", "left_semi"), "similar")
    met = prints.select(F.lit(0).alias("t"), F.explode("first").alias("key"), "node", *cols)
    links = _met(met, _linked(radius(similarity, width), width, pivots, None))
    if (frequent[1] >= HOT_SHINGLE).any():
        links = links.union(_hot_links(prints))
    near = staged(components(links.distinct()), "similar-near")
    sizes = near.join(prints.select("node", "n"), "node").groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
    large = staged(sizes.where((F.col("c") > TOGETHER) | (F.col("m") > TOGETHER_SHINGLES)).select("component"), "similar-sizes")
    held = texts.select(F.col("row").alias("node"), "text").join(_small(near), "node")
    some = bool(large.limit(1).count())
    few = (held.join(_small(large), "component", "left_anti") if some else held).select("component", "node", "text")
    dealt = few.repartition(shuffle_partitions(texts.sparkSession), "component").sortWithinPartitions("component", "node")
    roots = dealt.mapInArrow(_verified(words, similarity, width), "node long, root long")
    if some:
        many = held.join(_small(large), "component", "left_semi").join(prints.select("node", "n", *cols), "node")
        roots = roots.union(_probed(many, words, similarity, width))
    roots = staged(roots, "similar-roots")
    named = nodes.join(roots, "node").groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(named, "root").select("node", "root", "component_id", F.lit(True).alias("linked"))
    whole = nodes.join(linked, "node", "left").select("d0", "d1", F.coalesce("root", "node").alias("group"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return sets.join(whole, ["d0", "d1"]).select("row", "doc_id", "group", "component_id")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, width: int = WIDTH, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, component_id of each row, as similar_rows groups them."""
    return similar_rows(numbered(docs, "doc_id", "text"), words, similarity, width, pivots).select("doc_id", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """simhash_dedup over the whole table of documents; repeated rows get a row each, in one component."""
    return simhash_dedup(table(spark, sf_dir, "documents"))
