"""A cleaning pipeline over documents: toxic ones go, exact and near copies go, sources are mixed, texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, mixing, shared, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts of word shingles count as near copies from this similarity on.
WORDS, SIMILARITY = 5, 0.8


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a row id of their own, unique and not null, whatever their doc_id."""
    return shared.numbered(docs, *COLUMNS)


def _keep(rows: DataFrame, kept: DataFrame) -> DataFrame:
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject; it learns from the labels among its own input."""
    rows = _numbered(docs)
    judged = toxicity.toxicity(rows, shared.table(spark, sf_dir, "labels"), row="row")
    return _keep(rows, judged.where("predicted = 0").select("row"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row that the operator keeps; of several with that doc_id the longest one."""
    rows = _numbered(docs)
    judged = exact_dedup.exact_dedup(rows.withColumn("less", -F.length("text")), carry=("row", "less")).where("kept")
    one = judged.groupBy("text_sha256").agg(F.min(F.struct(F.coalesce("less", F.lit(0)).alias("less"), "row")).alias("o"))
    return _keep(rows, one.select("o.row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays (a null one counts as larger than any)."""
    rows = _numbered(docs)
    groups = simhash.similar_rows(rows, WORDS, SIMILARITY)
    one = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("o"))
    return _keep(rows, one.select("o.row"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (never, once or twice)."""
    rows = _numbered(docs)
    taken = mixing.mix(rows, carry=("row",)).where("taken > 0").select("row", F.expr("CAST(taken div size AS INT)").alias("times"))
    return rows.join(taken, "row").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned scores and fingerprints of wide hashes can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; what each returns is written as Parquet and read again."""
    docs = shared.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.staged(docs, f"pipeline-{name}")
    return docs
