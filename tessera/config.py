"""Federations from a specification (a dictionary, or JSON text): sources by loader, ontologies, templates."""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession

from .federation import Federation
from .reasoning import TBox
from .sources.files import csv_source, jdbc_source, json_source
from .sources.r2rml import R2rml
from .sources.remote import BATCH, SparqlSource
from .sources.table import from_context
from .sources.triples import parquet_store, rdf_file, read_text

FILE_KEYS = ("file", "files", "url", "urls", "uri", "uris", "location", "locations")


def _paths(entry: dict, base: str) -> list[str]:
    found = [p for k in FILE_KEYS for p in ([entry[k]] if isinstance(entry.get(k), str) else entry.get(k, []))]
    return [p if "://" in p or os.path.isabs(p) else os.path.join(base, p) for p in found]


def _context(spark: SparkSession, entry: dict, base: str) -> dict:
    c = entry["context"]
    return json.loads(read_text(spark, os.path.join(base, c))) if isinstance(c, str) else c


LOADERS = {
    "rdf-file": lambda s, e, b, n: [rdf_file(s, _paths(e, b), n)],
    "rdf-store": lambda s, e, b, n: [parquet_store(s, _paths(e, b)[0], n)],
    "table": lambda s, e, b, n: [from_context(s.table(e["table"]) if "table" in e else s.read.parquet(*_paths(e, b)), _context(s, e, b), n, e.get("links"), e.get("unique", True))],
    "csv": lambda s, e, b, n: [csv_source(s, _paths(e, b)[0], _context(s, e, b), n, e.get("separator"), turtle_cells=e.get("turtle-cells", False), links=e.get("links"))],
    "json": lambda s, e, b, n: [json_source(s, _paths(e, b)[0], _context(s, e, b), n, e.get("lines", True), e.get("links"))],
    "jdbc": lambda s, e, b, n: [jdbc_source(s, e["jdbc"], e["table"], _context(s, e, b), n, e.get("links"), e.get("partition-column"), e.get("partitions", 16))],
    # Any source that Spark has a reader for, by its format's name (a Cassandra connector's, for one).
    "spark": lambda s, e, b, n: [from_context(s.read.format(e["format"]).options(**e.get("options", {})).load(*_paths(e, b)), _context(s, e, b), n, e.get("links"), e.get("unique", True))],
    "sparql": lambda s, e, b, n: [SparqlSource(s, next(e[k] for k in FILE_KEYS if k in e), n, e.get("describe", "ask"), e.get("bind", True), e.get("batch", BATCH))],
    "r2rml": lambda s, e, b, n: R2rml(s, read_text(s, _paths(e, b)[0]), s.table, e.get("base", "http://example.org/base/"), e.get("strict", True)).sources(),
}


def load(spark: SparkSession, spec: dict | str, base: str = ".") -> Federation:
    """spec: `sources` (each with `loader` and what it needs), `tbox` (Turtle files), `templates`, `dedup-sources`."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    fed = Federation(spark, dedup_sources=spec.get("dedup-sources", False), on_source_error=spec.get("on-source-error", "raise"))
    for k, entry in enumerate(spec.get("sources", [])):
        if entry["loader"] not in LOADERS:
            raise ValueError(f"unknown loader {entry['loader']!r}; there are {sorted(LOADERS)}")
        for source in LOADERS[entry["loader"]](spark, entry, base, entry.get("name", f"source{k}")):
            fed.add_source(source)
    if spec.get("tbox"):
        fed.use_tbox(TBox.from_turtle("\n".join(read_text(spark, p) for p in _paths({"files": spec["tbox"]}, base))))
    for t in spec.get("templates", []):
        fed.register_template(t["iri"], t["subject"], t["object"], t["pattern"])
    return fed
