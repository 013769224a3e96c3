"""The star-schema test tables as a graph: a context mapping per table."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .federation import Federation
from .sources.table import from_context

BASE, NS = "http://tessera.test/", "http://tessera.test/ns#"
#: Table: (class, key column or columns (None: blank nodes), table that a foreign key names).
TABLES = {
    "region": ("Region", "r_regionkey", {}),
    "nation": ("Nation", "n_nationkey", {"n_regionkey": "region"}),
    "customer": ("Customer", "c_custkey", {"c_nationkey": "nation"}),
    "supplier": ("Supplier", "s_suppkey", {"s_nationkey": "nation"}),
    "part": ("Part", "p_partkey", {}),
    "orders": ("Order", "o_orderkey", {"o_custkey": "customer"}),
    "lineitem": ("Lineitem", None, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": ("Event", "event_id", {"user_id": "customer"}),
    "documents": ("Document", "doc_id", {}),
    "labels": ("Label", None, {"doc_id": "documents"}),
    "pages": ("Page", "page_id", {}),
    "conversations": ("Turn", ["conv_id", "turn"], {}),
    "benchmark": ("Item", "item_id", {}),
    "embeddings": ("Vector", "vec_id", {}),
}
PREFIXES = f"PREFIX : <{NS}> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> PREFIX t: <{BASE}> "


def context(name: str) -> tuple[dict, dict]:
    """The context document of a table, and its foreign keys' prefixes. Predicates are the column names in NS."""
    cls, key, links = TABLES[name]
    return {"@context": {"@type": NS + cls, "@uriProperty": key or "@blank"}, "@instancePrefix": f"{BASE}{name}/", "@fallbackPrefix": NS}, {c: f"{BASE}{t}/" for c, t in links.items()}


def federation(spark: SparkSession, sf_dir: str, tables=None, **options) -> Federation:
    fed = Federation(spark, **options)
    for name in tables or TABLES:
        ctx, links = context(name)
        fed.add_source(from_context(spark.read.parquet(f"{sf_dir}/{name}.parquet"), ctx, name, links))
    return fed
