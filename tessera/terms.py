"""RDF terms as they occur in queries and mappings."""

from __future__ import annotations

from dataclasses import dataclass

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
RDF_TYPE = RDF + "type"
STRING, BOOLEAN, INTEGER, DECIMAL, DOUBLE, FLOAT = (XSD + x for x in ("string", "boolean", "integer", "decimal", "double", "float"))
DATE, DATETIME, TIME, HEX = (XSD + x for x in ("date", "dateTime", "time", "hexBinary"))
LANG_STRING = RDF + "langString"
#: Datatypes whose values are integers.
INTEGERS = frozenset(XSD + x for x in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte"))
NUMERIC = INTEGERS | {DECIMAL, DOUBLE, FLOAT}


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Blank:
    """In a query a variable that can't be selected; in data a node without a name."""

    label: str


@dataclass(frozen=True)
class Lit:
    lex: str
    dt: str = STRING
    lang: str | None = None


Term = Var | Iri | Blank | Lit


def ntriples(t: Term) -> str:
    if isinstance(t, Iri):
        return f"<{t.value}>"
    if isinstance(t, Blank):
        return f"_:{t.label}"
    if isinstance(t, Var):
        return f"?{t.name}"
    text = '"' + t.lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
    return text + (f"@{t.lang}" if t.lang else "" if t.dt == STRING else f"^^<{t.dt}>")
