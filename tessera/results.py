"""Result formats: CSV, TSV and JSON as SPARQL 1.1 defines them, as text columns that any task can write."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.relation import Relation, as_term, ntriples_text
from .terms import STRING


def _terms(r: Relation) -> dict[str, Column]:
    return {v: as_term(r.col(v), b) for v, b in r.vars.items()}


def csv_lines(r: Relation) -> DataFrame:
    """One line per row (`value`): plain text, quoted where it holds a quote, comma or line break."""
    def cell(t: Column) -> Column:
        text = t["lex"]
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when(text.rlike('[",\n\r]'), quoted).otherwise(text), F.lit(""))

    cells = [cell(t) for t in _terms(r).values()]
    return r.df.select((F.concat_ws(",", *cells) if cells else F.lit("")).alias("value"))


def csv_header(r: Relation) -> str:
    return ",".join(r.vars)


def tsv_lines(r: Relation) -> DataFrame:
    cells = [F.coalesce(ntriples_text(t), F.lit("")) for t in _terms(r).values()]
    return r.df.select((F.concat_ws("\t", *cells) if cells else F.lit("")).alias("value"))


def tsv_header(r: Relation) -> str:
    return "\t".join(f"?{v}" for v in r.vars)


def json_bindings(r: Relation) -> DataFrame:
    """One binding object per row (`value`); unbound variables and the datatype xsd:string are left out."""
    def one(t: Column) -> Column:
        kind = F.when(t["k"] == "I", F.lit("uri")).when(t["k"] == "B", F.lit("bnode")).otherwise(F.lit("literal"))
        value = F.when(t["k"] == "B", t["lex"].substr(F.lit(3), F.length(t["lex"]))).otherwise(t["lex"])
        dt = F.when(t["lang"].isNull() & (t["dt"] != STRING), t["dt"])
        return F.when(t.isNotNull(), F.struct(kind.alias("type"), value.alias("value"), t["lang"].alias("xml:lang"), dt.alias("datatype")))

    cols = [one(t).alias(v) for v, t in _terms(r).items()]
    return r.df.select((F.to_json(F.struct(*cols)) if cols else F.lit("{}")).alias("value"))


def json_pieces(r: Relation, ask: bool = False) -> Iterator[str]:
    """A result document in pieces, a binding each, as rows are read."""
    if ask:
        yield json.dumps({"head": {}, "boolean": not r.df.isEmpty()})
        return
    comma = ""
    yield f'{{"head":{{"vars":{json.dumps(list(r.vars))}}},"results":{{"bindings":['
    for x in json_bindings(r).toLocalIterator():
        yield comma + x["value"]
        comma = ","
    yield "]}}"


def json_document(r: Relation, ask: bool = False) -> str:
    """A whole result document, for results that fit the driver."""
    return "".join(json_pieces(r, ask))


def write(r: Relation, path: str, how: str = "csv") -> None:
    """Writes a folder of text files, one per task; the header is the file `_header` of the CSV and TSV forms' folder name."""
    lines = {"csv": csv_lines, "tsv": tsv_lines, "json": json_bindings}[how](r)
    lines.write.text(path, lineSep="\r\n" if how == "csv" else "\n")
