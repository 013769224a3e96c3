"""Exact duplicates (7): counting quotient filters per partition, merged losslessly; repeated fingerprints go to byte verification."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import release_caches
from .shared import SPACE_CLASS, only, settled, shuffle_partitions, staged, table

#: Repeated fingerprints are broadcast up to this count (8 bytes each), and joined by a shuffle beyond it.
BROADCAST_FINGERPRINTS = 1_000_000
#: Rows of one bucket of the fingerprint space, about, and entries that are merged at once.
BUCKET_ROWS, MERGED = 1_000_000, 4_000_000


class CountingQuotientFilter:
    """A lossless counting quotient filter of 64-bit fingerprints, built at once from a sorted multiset.

    The high q bits (quotient) of a fingerprint name its home slot, the other bits (remainder) are stored. Runs of equal
    quotient lie in remainder order at their home slot or as near behind it as earlier runs allow (linear probing).
    Two bits per slot (occupied: some fingerprint has this home; run end) recover each slot's quotient, so nothing is lost.
    """

    def __init__(self, qbits: int, occupied: np.ndarray, runend: np.ndarray, used: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.qbits, self.occupied, self.runend, self.used, self.remainders, self.counts = qbits, occupied, runend, used, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        fp = fingerprints.astype(np.uint64)
        if counts is None:
            fp, counts = np.unique(fp, return_counts=True)
        else:
            order = np.argsort(fp, kind="stable")
            fp, counts = fp[order], counts[order]
            first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]][: len(fp)])
            fp, counts = fp[first], np.add.reduceat(counts, first) if len(first) else counts
        n = len(fp)
        qbits = max(1, int(np.ceil(np.log2(max(n, 1) * 1.25 + 1))))
        q = (fp >> np.uint64(64 - qbits)).astype(np.int64)
        at = np.arange(n)
        slot = at + np.maximum.accumulate(q - at) if n else at
        size = max(1 << qbits, int(slot[-1]) + 1 if n else 0)
        occupied, runend, used = (np.zeros(size, bool) for _ in range(3))
        occupied[q] = True
        used[slot] = True
        if n:
            runend[slot[np.r_[q[1:] != q[:-1], True]]] = True
        return cls(qbits, occupied, runend, used, fp & np.uint64((1 << (64 - qbits)) - 1), counts.astype(np.int64))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in ascending order with their counts."""
        runs = self.runend[self.used]
        run = np.cumsum(runs) - runs
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)[run]
        return (quotients << np.uint64(64 - self.qbits)) | self.remainders, self.counts

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        (a, m), (b, n) = self.items(), other.items()
        return self.build(np.r_[a, b], np.r_[m, n])

    @classmethod
    def merge_all(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """All at once, by their sorted quotients and remainders: each entry moves once, whatever the number of filters."""
        items = [f.items() for f in filters]
        return cls.build(np.concatenate([x for x, _ in items]), np.concatenate([n for _, n in items]))

    def to_bytes(self) -> bytes:
        bits = np.packbits(np.concatenate([self.occupied, self.runend, self.used])).tobytes()
        width = (64 - self.qbits + 7) // 8
        rem = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        many = np.flatnonzero(self.counts > 1)
        return struct.pack("<BQQQ", self.qbits, len(self.occupied), len(self.remainders), len(many)) + bits + rem + many.astype("<u8").tobytes() + self.counts[many].astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        qbits, size, n, k = struct.unpack_from("<BQQQ", data)
        at = struct.calcsize("<BQQQ")
        nb = (3 * size + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, nb, at))[: 3 * size].astype(bool)
        width = (64 - qbits + 7) // 8
        rem = np.zeros((n, 8), np.uint8)
        rem[:, :width] = np.frombuffer(data, np.uint8, n * width, at + nb).reshape(n, width)
        at += nb + n * width
        counts = np.ones(n, np.int64)
        counts[np.frombuffer(data, "<u8", k, at).astype(np.int64)] = np.frombuffer(data, "<i8", k, at + 8 * k)
        return cls(qbits, bits[:size], bits[size : 2 * size], bits[2 * size :], rem.view("<u8").ravel(), counts)


def _filters(buckets_log2: int):
    """One filter for each bucket (the top bits of the fingerprints) of a partition's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        held, n = [], 0

        def emit():
            fp, counts = np.unique(np.concatenate(held), return_counts=True)
            top = (fp >> np.uint64(64 - buckets_log2)).astype(np.int64) if buckets_log2 else np.zeros(len(fp), np.int64)
            cut = np.r_[np.flatnonzero(np.r_[True, top[1:] != top[:-1]]), len(fp)]
            rows = [(int(top[a]), CountingQuotientFilter.build(fp[a:b] << np.uint64(buckets_log2), counts[a:b]).to_bytes()) for a, b in zip(cut[:-1], cut[1:])]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "filter"])

        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += b.num_rows
            if n >= 2_000_000:
                yield emit()
                held, n = [], 0
        if n:
            yield emit()

    return run


def _merged(buckets_log2: int):
    """Merges the filters of each bucket, met in bucket order; emits what occurs more than once.

    Filters are merged MERGED entries at a time, the result with the next ones: a bucket's task holds its different
    fingerprints and so many entries more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        now, held, entries, grown = None, [], 0, 0

        def repeated():
            fp, counts = CountingQuotientFilter.merge_all(held).items()
            fp, counts = fp[counts > 1], counts[counts > 1]
            full = (fp >> np.uint64(buckets_log2)) | (np.uint64(now) << np.uint64(64 - buckets_log2) if buckets_log2 else np.uint64(0))
            return pa.RecordBatch.from_arrays([pa.array(full.view(np.int64)), pa.array(counts)], ["fp", "n"])

        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if bucket != now:
                    if held:
                        yield repeated()
                    now, held, entries, grown = bucket, [], 0, 0
                held.append(CountingQuotientFilter.from_bytes(data))
                entries += len(held[-1].remainders)
                if entries > max(MERGED, 2 * grown):  # amortised: a merge waits until the entries have doubled
                    held = [CountingQuotientFilter.merge_all(held)]
                    entries = grown = len(held[0].remainders)
        if held:
            yield repeated()

    return run


def bucket_bits(rows: int) -> int:
    """So many buckets, as a power of two, that each holds about BUCKET_ROWS rows, 2 to the 8th at least."""
    return max(8, int(np.ceil(np.log2(max(rows, 1) / BUCKET_ROWS))))


def repeated_fingerprints(fingerprints: DataFrame, buckets_log2: int | None = None) -> DataFrame:
    """(fp, n) for each 64-bit value of the one long column that occurs n > 1 times.

    Each input partition builds one filter per bucket of the fingerprint space; a bucket's filters meet in one task and
    merge by sorted remainders. A value's thousand copies are one entry with a count, so hot values add nothing. The
    number of buckets follows the number of rows, so that a bucket's size doesn't.
    """
    spark = fingerprints.sparkSession
    bits = bucket_bits(fingerprints.count()) if buckets_log2 is None else buckets_log2
    made = fingerprints.mapInArrow(_filters(bits), "bucket int, filter binary")
    n = min(max(shuffle_partitions(spark), 1 << bits >> 3), 1 << bits)
    met = made.repartition(n, "bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(_merged(bits), "fp long, n long")


def normalized(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+", "")


def exact_dedup(docs: DataFrame, buckets_log2: int | None = None, broadcast_limit: int = BROADCAST_FINGERPRINTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the columns named in carry.

    Texts are equal when identical without white space; null counts as empty. Of equal texts the one with the most code
    points, then the smallest doc_id, stays (a null doc_id counts as larger than any). Rows that repeat a doc_id are
    documents of their own; of several with the winning text and doc_id all are `kept`, as they can't be told apart by
    them (carry a row id to choose one). An empty table gives an empty result; other columns are ignored.

    fingerprints -> counting quotient filters -> fingerprints with a count above one -> only those texts are compared
    byte by byte (grouped by the text itself, with map-side combining) -> joined back to the slim table.
    """
    return settled("exact-classes", docs.sparkSession, lambda: _exact_dedup(docs, buckets_log2, broadcast_limit, carry))


def _exact_dedup(docs: DataFrame, buckets_log2: int | None, broadcast_limit: int, carry: tuple[str, ...]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    with_norm = only(docs, "doc_id", "text", *carry).select(*carry, "doc_id", F.length(text).alias("len"), normalized(F.col("text")).alias("norm"))
    slim = staged(with_norm.select(*carry, "doc_id", "len", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha")), "exact")
    many = staged(repeated_fingerprints(slim.select("fp"), buckets_log2).select("fp"), "exact-many")
    small = many.count() <= broadcast_limit
    candidates = with_norm.withColumn("fp", F.xxhash64("norm")).join(F.broadcast(many) if small else many, "fp", "left_semi")
    # One mutable decimal, 2e19 * length - doc_id (null: 1e19), orders by length, then by smallest id, so that Spark can
    # aggregate by hash with the text as key.
    top, step = "CAST('10000000000000000000' AS DECIMAL(20,0))", "CAST('20000000000000000000' AS DECIMAL(20,0))"
    order = F.expr(f"CAST(CAST(len AS DECIMAL(12,0)) * {step} - coalesce(CAST(doc_id AS DECIMAL(20,0)), {top}) AS DECIMAL(38,0))")
    verified = candidates.select("norm", order.alias("o")).groupBy("norm").agg(F.max("o").alias("o"), F.count("*").alias("group_size"))
    classes = verified.where("group_size > 1").select(F.unhex(F.sha2("norm", 256)).alias("sha"), "o", "group_size")
    # A class is named by its digest in the join below; two verified texts with one digest would be an error, so say so.
    classes = classes.groupBy("sha").agg(F.max("o").alias("o"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts"))
    classes = classes.withColumn("o", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("decimal(38,0)")).otherwise(F.col("o")))
    keep = F.expr(f"CAST(CAST((o + {top}) div {step} AS DECIMAL(12,0)) * {step} - o AS DECIMAL(38,0))")
    classes = classes.select("sha", "group_size", F.when(keep < F.expr(top), keep.cast("long")).alias("keep_id"), F.lit(True).alias("many"))
    out = slim.join(classes, "sha", "left")
    keep_id = F.when(F.col("many"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep_id.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), *carry)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_dedup over the whole table of documents; see there for nulls, repeats and empty tables."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM t WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id))
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
