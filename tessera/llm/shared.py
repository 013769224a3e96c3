"""What several operators share: the scratch folder, staged tables, column hygiene, connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space wherever a contract says so, as a Java and a DuckDB regex class body.
SPACE_CLASS = r"\x20\x09-\x0D"

_local_dir: list[str] = []


class _Scopes(threading.local):
    """For each settled() that the thread has under way: the folders written since."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder of its own; a cluster gets an error, because executors
    don't see each other's local folders.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="tessera-"))
    return f"file://{_local_dir[0]}"


def staged(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes.open:
        _scopes.open[-1].append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(label: str, spark: SparkSession, compute: Callable[[], DataFrame]) -> DataFrame:
    """compute()'s rows as a staged table. Whatever compute staged on its way is deleted once they are written."""
    _scopes.open.append([])
    try:
        rows = compute()
        made = _scopes.open.pop()
        try:
            return staged(rows, label)
        finally:
            _scopes.open.append(made)
    finally:
        for path in _scopes.open.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, *columns: str) -> DataFrame:
    """The columns with `row` before them: a long, unique and not null, which is the same each time the rows are read.

    Rows of files are named by a hash of their file and their position in it, without a copy; other rows are staged.
    """
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.child()
    if node.nodeName().startswith(("Relation", "LogicalRelation")):
        try:
            meta = df.metadataColumn("_metadata")
            for seed in range(8):
                file = F.pmod(F.xxhash64(meta["file_path"], F.lit(seed)), F.lit(1 << 33))
                files = df.select(meta["file_path"].alias("p"), file.alias("f"), meta["row_index"].alias("i")).agg(F.count_distinct("p") == F.count_distinct("f"), F.max("i")).first()
                if files[0] and (files[1] or 0) < 1 << 30:
                    return df.select((F.shiftleft(file, 30) + meta["row_index"]).alias("row"), *[F.col(f"`{c}`") for c in columns])
        except AnalysisException:  # not files that tell where a row lies
            pass
    return staged(df.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`") for c in columns]), "rows")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns that an operator works on, by exact name, whatever else the table holds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph given as (a, b) longs: one row (node, component) per node of an edge.

    component is the smallest node of its component. Alternating large-star and small-star rounds, each staged, until
    the edge set no longer changes; a hub's edges are split by adaptive skew joins, never gathered in one task.
    """
    return settled("components", edges.sparkSession, lambda: _components(edges, max_rounds))


def _components(edges: DataFrame, max_rounds: int) -> DataFrame:
    def summary(e: DataFrame):
        return e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()

    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = summary(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = staged(small, "cc")
        after = summary(edges)
        if tuple(after) == tuple(before):
            break
        before = after
    else:
        raise RuntimeError(f"components: no fixpoint within {max_rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
