"""Approximate nearest neighbours (4): a balanced partition of a neighbour graph, and a classifier that routes queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import only, settled, staged, table

#: Vectors that partition and classifier are fitted on, at most (those with the smallest hash of the id).
FIT_ROWS = 8192
GRAPH_NEIGHBOURS, BALANCE = 10, 1.1
#: Fewest and most partitions; between them there is one for every BLOCK_ROWS vectors. The fitted sample supports no more.
LEAST_PARTS, MOST_PARTS = 16, 256
#: Recall on the fitted sample that decides how many partitions a query visits.
AIM = 0.95
#: Vectors, and queries, that one task compares at once.
BLOCK_ROWS, QUERY_ROWS = 20_000, 8192


def nearest(x: np.ndarray, q: np.ndarray, k: int, ids: np.ndarray | None = None, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of q: positions in x of its k nearest and their exact Euclidean distances, ties by id.

    own: ids of the queries, whose rows in x don't count. A matrix product finds what can be among the nearest; these
    distances are then computed exactly.
    """
    ids = np.arange(len(x)) if ids is None else ids
    norms = (x * x).sum(1)
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        near = norms[None, :] - 2 * part @ x.T + (part * part).sum(1)[:, None]
        for i in range(len(part)):
            d = near[i]
            mine = np.flatnonzero(ids == own[at + i]) if own is not None else []
            d[mine] = np.inf
            slack = 1e-9 * (norms.max(initial=0) + float(part[i] @ part[i]) + 1)
            edge = np.partition(d, k - 1)[k - 1] + slack if len(d) > k else np.inf
            c = np.flatnonzero((d <= edge) & (d < np.inf))
            exact = np.sqrt(((x[c] - part[i]) ** 2).sum(1))
            order = np.lexsort((ids[c], exact))[:k]
            yield c[order], exact[order]


def balanced_parts(x: np.ndarray, parts: int, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(part of each row, neighbour graph): parts of nearly equal size that cut few edges of the k-nearest-neighbour graph.

    Starts from balanced clusters; then rows move to the part that holds most of their neighbours, those that gain most
    first, while no part exceeds BALANCE times the mean.
    """
    n = len(x)
    parts = max(1, min(parts, n))
    rng = np.random.default_rng(seed)
    graph = np.array([[*c, *[-1] * (GRAPH_NEIGHBOURS - len(c))] for c, _ in nearest(x, x, min(GRAPH_NEIGHBOURS, max(n - 1, 1)), own=np.arange(n))]).reshape(n, -1)
    most = int(np.ceil(BALANCE * n / parts))
    centres = x[rng.choice(n, parts, replace=False)]

    def fill(score: np.ndarray) -> np.ndarray:
        """The best part of each row that has room; rows with the clearest preference choose first."""
        ranked = np.argsort(-score, axis=1)
        top2 = np.sort(score, axis=1)[:, ::-1][:, :2]
        order = np.argsort(-(top2[:, 0] - top2[:, -1]), kind="stable")
        room, out = np.full(parts, most), np.zeros(n, np.int64)
        for i in order.tolist():
            for p in ranked[i]:
                if room[p]:
                    room[p] -= 1
                    out[i] = p
                    break
        return out

    part = np.zeros(n, np.int64)
    for _ in range(8):
        part = fill(2 * x @ centres.T - (centres**2).sum(1))
        centres = np.stack([x[part == p].mean(0) if (part == p).any() else x[rng.integers(n)] for p in range(parts)])
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        for j in range(graph.shape[1]):
            there = graph[:, j] >= 0
            votes[np.flatnonzero(there), part[graph[there, j]]] += 1
        moved = fill(votes + 0.5 * np.eye(parts)[part])
        if (moved == part).all():
            break
        part = moved
    return part, graph


class Router:
    """A softmax classifier of vectors into partitions."""

    def __init__(self, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.mean, self.scale = weights, mean, scale

    @classmethod
    def fit(cls, x: np.ndarray, part: np.ndarray, parts: int, rounds: int = 400) -> Router:
        mean, scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[(x - mean) / scale, np.ones(len(x))]
        w, m, v = (np.zeros((z.shape[1], parts)) for _ in range(3))
        target = np.eye(parts)[part]
        for t in range(1, rounds + 1):
            s = z @ w
            p = np.exp(s - s.max(1, keepdims=True))
            g = z.T @ (p / p.sum(1, keepdims=True) - target) / len(z) + 1e-4 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return cls(w, mean, scale)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """All partitions of each row, most probable first."""
        return np.argsort(-(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weights), axis=1, kind="stable")


def fit(x: np.ndarray, parts: int = LEAST_PARTS, k: int = 10, aim: float = AIM) -> tuple[Router, int]:
    """The router, and how many partitions a query visits: the fewest that find `aim` of the sample's own neighbours."""
    x = np.unique(x, axis=0)
    part, graph = balanced_parts(x, parts)
    parts = int(part.max()) + 1
    router = Router.fit(x, part, parts)
    ranked = router.ranked(x)
    home = ranked[:, 0]
    place = np.argsort(ranked, axis=1)  # rank of each partition for each row
    visited = np.where(graph >= 0, place[np.arange(len(x))[:, None], home[graph]], -1)
    held = np.sort(visited[graph >= 0])
    return router, int(held[min(len(held) - 1, int(np.ceil(aim * len(held))) - 1)]) + 1 if len(held) else parts


def _vectors(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<f8").reshape(len(col), -1)


def _placed(router: Router, visits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack([np.asarray(v, np.float64) for v in b.column(1).to_pylist()]) + 0.0  # no negative zeros
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(router.ranked(x)[:, :visits].astype(np.int32).tolist(), pa.list_(pa.int32()))], ["vec_id", "vec", "parts"])

    return run


def _compared(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        if not len(vectors) or not len(queries):
            return none
        x, q = (np.frombuffer(b"".join(d["vec"]), "<f8").reshape(len(d), -1) for d in (vectors, queries))
        ids, name = vectors["vec_id"].to_numpy(), queries["q"].to_numpy()
        out = [(np.full(len(c), name[i]), ids[c], s) for i, (c, s) in enumerate(nearest(x, q, k, ids))]
        return pd.DataFrame({n: np.concatenate(v) for n, v in zip(none.columns, zip(*out))})

    return run


def dealt(rows: DataFrame, queries: DataFrame, sizes: list) -> tuple[DataFrame, DataFrame]:
    """(vectors, queries) by part, block and share. sizes: rows (p, n, q) with each partition's vectors and queries.

    Vectors of a partition are dealt over blocks of about BLOCK_ROWS, its queries over shares of QUERY_ROWS, and every
    block meets every share: a vector is copied once per share, a query once per block of each partition it visits.
    Both numbers are of the partition's own size, so that copies don't grow with the table while partitions do.
    """
    spark = rows.sparkSession
    counts = spark.createDataFrame([(r["p"], max(1, -(-r["n"] // BLOCK_ROWS)), max(1, -(-r["q"] // QUERY_ROWS))) for r in sizes], "part int, blocks int, shares int")
    counts = F.broadcast(counts)  # a row per partition, MOST_PARTS at most
    slot = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.select("vec_id", "vec", F.col("parts")[0].alias("part")).join(counts, "part")
    left = left.withColumn("block", slot("vec_id", "blocks", 1)).withColumn("share", every("shares")).drop("blocks", "shares")
    right = queries.select("q", "vec", F.explode("parts").alias("part")).join(counts, "part")
    right = right.withColumn("share", slot("q", "shares", 2)).withColumn("block", every("blocks")).drop("blocks", "shares")
    return left, right


def search(embeddings: DataFrame, every: int = 100, k: int = 10, parts: int | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose vec_id is divisible by `every`.

    Rows without vec_id, with a null or all-zero vector, with null or non-finite components, or whose vector isn't of
    the most frequent length take no part. Rows that repeat a vec_id are candidates each, never for their own id; as
    queries each has a list of its own vector, and equal ones one list. Router and partition are fitted on a bounded
    sample; all rows are indexed. Of equal vectors only those with the smallest ids can be among the nearest: so many
    stay, which is exact; equal queries are searched once. Without valid rows the result is empty.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    return settled("ann", embeddings.sparkSession, lambda: _search(embeddings, every, k, parts, fit_rows, schema))


def _search(embeddings: DataFrame, every: int, k: int, parts: int | None, fit_rows: int, schema: str) -> DataFrame:
    spark = embeddings.sparkSession
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    usable = only(embeddings, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0))
    length = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], schema)
    usable = usable.where(F.size("embedding") == length["d"])
    parts = parts or min(MOST_PARTS, max(LEAST_PARTS, -(-length["count"] // BLOCK_ROWS)))
    sample = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).collect()  # fit_rows at most
    router, visits = fit(np.array([r["embedding"] for r in sample], np.float64), parts, k)
    placed = staged(usable.mapInArrow(_placed(router, visits), "vec_id long, vec binary, parts array<int>"), "ann-placed")
    repeats = placed.groupBy("vec_id").count().agg(F.max("count")).first()[0]
    among = k + repeats  # a query's own rows are taken out of what is found
    least = Window.partitionBy("vec").orderBy("vec_id")
    rows = staged(placed.withColumn("r", F.row_number().over(least)).where(F.col("r") <= among).select("vec_id", "vec", F.slice("parts", 1, 1).alias("parts")), "ann-rows")
    asked = placed.where(F.col("vec_id") % every == 0)
    queries = staged(asked.groupBy("vec").agg(F.min("vec_id").alias("first"), F.first("parts").alias("parts")).select(F.monotonically_increasing_id().alias("q"), "vec", "parts"), "ann-queries")
    mine = rows.groupBy(F.col("parts")[0].alias("p")).agg(F.count("*").alias("n"))
    theirs = queries.select(F.explode("parts").alias("p")).groupBy("p").agg(F.count("*").alias("q"))
    sizes = mine.join(theirs, "p", "left").select("p", "n", F.coalesce("q", F.lit(0)).alias("q")).collect()  # a row per partition
    left, right = dealt(rows, queries, sizes)
    keys = ["part", "block", "share"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_compared(among), "q long, vec_id long, score double")
    best = Window.partitionBy("q").orderBy("score", "vec_id")
    lists = staged(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= among).select("q", "vec_id", "score"), "ann-found")
    named = asked.select(F.col("vec_id").alias("query_id"), "vec").distinct().join(queries.select("q", "vec"), "vec").select("query_id", "q")
    of_query = named.join(lists, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("score", "vec_id"))
    return of_query.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search over the whole table of embeddings; see there for what takes no part, repeats and empty tables."""
    return search(table(spark, sf_dir, "embeddings"))
