"""Mixing sources to target weights (8): weighted fair queueing over shuffled documents, truncated at the total budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACE_CLASS, only, staged, table

#: Rows that one prefix-sum bucket holds on average.
BUCKET_ROWS = 20_000


def source_targets(sizes: DataFrame, weights: list[int], budget_share: float, max_repeat: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares of the budget by weight, each at most max_repeat sizes.

    Water filling: sorted by cap/weight, the sources before the first one that its share does not fill are at their
    caps, and all others get the same multiple of their weight. Sources may be many: only window sums are used.
    """
    n = len(weights)
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(n)) + 1).cast("int"))
    caps = ranked.withColumn("w", weight.cast("double")).withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = caps.withColumn("budget", F.lit(budget_share) * F.sum("source_size").over(everything))
    filled = filled.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    filled = filled.withColumn("last", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("r"), "rank", "level"))).over(everything)["level"])
    target = F.when(F.col("last").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("last") * F.col("w")))
    return filled.select("source", "source_size", target.alias("target"), "rank", "budget")


def _prefix(rows: DataFrame, group: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows of the group up to and with the row, in bucket order, then in order.

    Two levels: sums by bucket, added up over buckets; then sums within a bucket. No task holds more than a bucket.
    """
    totals = rows.groupBy(*group, bucket).agg(F.sum(value).alias("_t"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    base = totals.withColumn("_base", F.sum("_t").over(over.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t"))
    keys = [*group, bucket]
    left, right = rows.alias("l"), base.select(*keys, "_base").alias("r")
    joined = left.join(right, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left").select("l.*", "r._base")
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.col("_base") + F.sum(value).over(within)).drop("_base")


def mix(docs: DataFrame, weights: list[int] = (3, 1, 2), budget_share: float = 1.5, max_repeat: int = 2, seed: str = "mix", bucket_rows: int = BUCKET_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and the columns named in carry.

    size is the number of words (null or blank text: 0, and such a document is never taken). Within a source documents
    queue in the order of md5(seed, doc_id) and, for sources whose target exceeds their size, queue again up to
    max_repeat times. A queued document's virtual finish time is the source's words up to and with it, divided by the
    source's target; the mix is the queue of all sources in the order of these times, cut where its words exceed the
    budget. Null sources are one source, the last. Reruns agree: the order depends only on doc_id. Rows that repeat a
    doc_id are documents of their own, told apart by their size and carry. An empty table gives an empty result.
    """
    weights = list(weights)
    words = F.coalesce(F.regexp_count("text", F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")
    slim = staged(only(docs, "doc_id", "text", "source", *carry).select(*carry, "doc_id", "source", words.alias("size"), F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("key")), "mix")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = staged(source_targets(sizes, weights, budget_share, max_repeat), "mix-targets")
    rows = slim.count()
    buckets = max(1, -(-rows // bucket_rows))
    ranked = slim.alias("l").join(targets.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.*", "r.source_size", "r.target", "r.rank", "r.budget")
    ranked = ranked.withColumn("b", F.floor(F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(16**12) * buckets).cast("long"))
    queued = _prefix(ranked, ["rank"], "b", ["key", "doc_id", "size", *carry], "size", "cum")
    queued = queued.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
    queued = staged(queued.where("size > 0").select(*carry, "doc_id", "size", "rank", "key", "pass", "target", "budget", ((F.col("cum") + F.col("pass") * F.col("source_size")) / F.col("target")).alias("vft")), "mix-queue")
    # Finish times are spread evenly over [0, 1] by volume; what comes much later is beyond any budget and shares a bucket range.
    timed = queued.withColumn("b", F.least(F.floor(F.col("vft") * buckets), F.lit(16 * buckets) + F.pmod(F.xxhash64("key"), F.lit(buckets))).cast("long"))
    cut = _prefix(timed, [], "b", ["vft", "rank", "key", "pass", "size", *carry], "size", "total").where("total <= budget")
    keys = ["doc_id", "size", "rank", *carry]
    taken = cut.groupBy(*keys).agg(F.sum("size").alias("taken"), F.count("*").alias("n"))
    rank = targets.select("source", "source_size", "target", "rank")
    base = slim.alias("l").join(rank.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select(*[f"l.{c}" for c in carry], "l.doc_id", "l.size", "r.source_size", "r.target", "r.rank")
    copies = base.groupBy(*keys, "source_size", "target").agg(F.count("*").alias("copies"))
    out = copies.alias("l").join(taken.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left")
    out = out.select("l.*", F.coalesce("r.n", F.lit(0)).alias("n"))
    each = F.explode(F.transform(F.sequence(F.lit(1), F.col("copies")), lambda i: F.floor(F.col("n") / F.col("copies")) + F.when(i <= F.col("n") % F.col("copies"), 1).otherwise(0)))
    return out.select(*carry, "doc_id", "size", "source_size", "target", each.alias("k")).select("doc_id", "size", "source_size", "target", (F.col("k") * F.col("size")).cast("long").alias("taken"), *carry)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix over the whole table of documents; see there for nulls, repeats and empty tables."""
    return mix(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || doc_id) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
c AS (SELECT *, [3, 1, 2][((rank - 1) % 3 + 1)::INT]::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
m AS (SELECT arg_min(level, cap / w) AS last FROM l WHERE level <= cap / w),
t AS (SELECT source, source_size, rank, budget, CASE WHEN last IS NULL THEN cap ELSE least(cap, last * w) END AS target FROM l, m),
q AS (SELECT d.*, source_size, rank, budget, target, sum(size) OVER (PARTITION BY rank ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, (cum + pass * source_size)::DOUBLE / target AS vft FROM q, (VALUES (0), (1)) v(pass) WHERE size > 0),
o AS (SELECT doc_id, size, sum(size) OVER (ORDER BY vft, rank, key, pass ROWS UNBOUNDED PRECEDING) AS total, budget FROM p),
k AS (SELECT doc_id, sum(size) AS taken FROM o WHERE total <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken FROM q LEFT JOIN k USING (doc_id)
"""
