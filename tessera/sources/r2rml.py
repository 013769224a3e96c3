"""R2RML mappings (tables, queries, templates, columns, constants, classes, joins) to table sources."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relation import Binding, constant, natural_datatype
from ..terms import LANG_STRING, RDF_TYPE, STRING, XSD, Blank, Iri, Lit
from .table import Field, Mapping, TableSource
from .triples import TurtleReader

RR = "http://www.w3.org/ns/r2rml#"


class MappingError(ValueError):
    pass


def template_parts(text: str) -> list[tuple[bool, str]]:
    """(is a column, text) pieces of a template; `\\{` and `\\}` are braces."""
    out = []
    for m in re.finditer(r"\{((?:[^{}\\]|\\.)*)\}|((?:[^{}\\]|\\.)+)", text):
        piece = re.sub(r"\\(.)", r"\1", m[1] if m[1] is not None else m[2])
        out.append((m[1] is not None, piece))
    return out


def percent_encoded(c: Column) -> Column:
    """IRI-safe: all but unreserved ASCII characters are percent-encoded."""
    return F.replace(F.replace(F.replace(F.url_encode(c.cast("string")), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


class R2rml:
    """strict: a missing table is an error; else its triples map is skipped. Graph maps are ignored."""

    def __init__(self, spark: SparkSession, text: str, table: Callable[[str], DataFrame], base: str = "http://example.org/base/", strict: bool = True):
        self.spark, self.table, self.base, self.strict = spark, table, base, strict
        self.props: dict = defaultdict(lambda: defaultdict(list))
        for s, p, o in TurtleReader(text).triples():
            self.props[s][p.value].append(o)

    def get(self, node, name: str):
        return next(iter(self.props[node].get(RR + name, [])), None)

    def sources(self) -> list[TableSource]:
        maps = [s for s in list(self.props) if self.props[s].get(RR + "logicalTable") or self.props[s].get(RR + "subjectMap")]
        return [x for m in maps if (x := self._source(m)) is not None]

    def _frame(self, triples_map) -> DataFrame:
        logical = self.get(triples_map, "logicalTable")
        name, sql = self.get(logical, "tableName"), self.get(logical, "sqlQuery")
        return self.spark.sql(sql.lex) if sql is not None else self.table(name.lex.strip('"'))

    def _source(self, m) -> TableSource | None:
        try:
            df = self._frame(m)
        except Exception as e:
            if self.strict:
                raise MappingError(f"{m}: {e}") from e
            return None
        subject = self.get(m, "subjectMap")
        short = self.get(m, "subject")
        types = [c.value for c in self.props[subject].get(RR + "class", [])] if subject else []
        kinds = dict(df.dtypes)
        if short is not None:
            column, prefix, kind = F.lit(short.value), "", "string"
        else:
            column, prefix, kind = self._subject(subject, kinds)
        fields = []
        for po in self.props[m].get(RR + "predicateObjectMap", []):
            predicates = [p.value for p in self.props[po].get(RR + "predicate", [])] + [self.get(x, "constant").value for x in self.props[po].get(RR + "predicateMap", [])]
            objects = [self._constant(o) for o in self.props[po].get(RR + "object", [])]
            for om in self.props[po].get(RR + "objectMap", []):
                parent = self.get(om, "parentTriplesMap")
                if parent is not None:
                    df, made = self._parent(df, om, parent, len(fields))
                else:
                    made = self._object(om, dict(df.dtypes))
                objects.append(made)
            for p in predicates:
                if p == RDF_TYPE and all(o[1].kind == "iri" for o in objects):
                    fields += [Field(p, *o) for o in objects]
                else:
                    fields += [Field(p, *o) for o in objects]
        label = str(getattr(m, "value", getattr(m, "label", m)))
        return TableSource(df, Mapping(types, column, prefix, kind, fields, unique=False), label)

    def _constant(self, t) -> tuple[Column, Binding, str]:
        c, b = constant(t)
        return c, b, "string"

    def _subject(self, node, kinds: dict, rename: dict | None = None) -> tuple[Column | None, str, str]:
        if self._term_type(node) == "BlankNode":
            return None, "", "string"
        constant_ = self.get(node, "constant")
        if constant_ is not None:
            return F.lit(constant_.value), "", "string"
        column = self.get(node, "column")
        if column is not None:
            name = (rename or {}).get(column.lex.strip('"'), column.lex.strip('"'))
            return self._based(F.col(f"`{name}`").cast("string")), "", "string"
        return self._template(self.get(node, "template").lex, kinds, rename)

    def _template(self, text: str, kinds: dict, rename: dict | None = None) -> tuple[Column, str, str]:
        """A template's column behind its constant prefix; one integer column stays native."""
        parts = template_parts(text)
        prefix = ""
        if parts and not parts[0][0]:
            prefix, parts = parts[0][1], parts[1:]
        if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", prefix) and not (parts and not prefix):
            prefix = self.base + prefix
        names = [(rename or {}).get(t, t) if is_column else t for is_column, t in parts]
        if len(parts) == 1 and parts[0][0] and kinds.get(names[0]) in ("int", "bigint", "smallint", "tinyint"):
            return F.col(f"`{names[0]}`"), prefix, kinds[names[0]]
        pieces = [percent_encoded(F.col(f"`{n}`")) if is_column else F.lit(n) for (is_column, _), n in zip(parts, names)]
        return F.concat(*pieces) if pieces else F.lit(""), prefix, "string"

    def _based(self, c: Column) -> Column:
        return F.when(c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), c).otherwise(F.concat(F.lit(self.base), c))

    def _term_type(self, node) -> str | None:
        t = self.get(node, "termType")
        return t.value.removeprefix(RR) if isinstance(t, Iri) else None

    def _object(self, node, kinds: dict) -> tuple[Column, Binding, str]:
        constant_, column, template = (self.get(node, x) for x in ("constant", "column", "template"))
        kind, lang, dt = self._term_type(node), self.get(node, "language"), self.get(node, "datatype")
        if constant_ is not None:
            return self._constant(constant_)
        if kind == "BlankNode":
            return F.monotonically_increasing_id(), Binding("iri", "_:o"), "bigint"
        literal = kind == "Literal" or lang is not None or dt is not None
        if template is not None:
            if not literal:
                c, prefix, native = self._template(template.lex, kinds)
                return c, Binding("iri", prefix), native
            pieces = [F.col(f"`{t}`").cast("string") if is_column else F.lit(t) for is_column, t in template_parts(template.lex)]
            text = F.concat(*pieces)
        else:
            name = column.lex.strip('"')
            native = kinds[name]
            if kind == "IRI":
                return self._based(F.col(f"`{name}`").cast("string")), Binding("iri"), "string"
            if lang is None and (dt is None or dt.value == natural_datatype(native)):
                return F.col(f"`{name}`"), Binding("lit", dt=natural_datatype(native)), native
            text = F.col(f"`{name}`").cast("string")
        if lang is not None:
            return text, Binding("lit", dt=LANG_STRING, lang=lang.lex.lower()), "string"
        if dt is not None and dt.value != STRING:
            from ..functions.expressions import cast

            c, b = cast((text, Binding("lit", dt=STRING)), dt.value)
            return c, b, "string" if dt.value.startswith(XSD) is False else "typed"
        return text, Binding("lit", dt=STRING), "string"

    def _parent(self, df: DataFrame, om, parent, k: int) -> tuple[DataFrame, tuple[Column, Binding, str]]:
        """The parent's subject. Where the join columns cover its columns it is made from the child's, else joined."""
        subject = self.get(parent, "subjectMap")
        pairs = [(self.get(j, "child").lex.strip('"'), self.get(j, "parent").lex.strip('"')) for j in self.props[om].get(RR + "joinCondition", [])]
        template = self.get(subject, "template")
        used = {t for is_column, t in template_parts(template.lex) if is_column} if template is not None else {self.get(subject, "column").lex.strip('"')}
        rename = {p: c for c, p in pairs}
        if not pairs or used <= set(rename):
            kinds = dict(df.dtypes)
            c, prefix, native = self._subject(subject, kinds, rename)
            return df, (c, Binding("iri", prefix), native)
        other = self._frame(parent)
        c, prefix, native = self._subject(subject, dict(other.dtypes))
        right = other.select(c.alias(f"..parent{k}"), *[F.col(f"`{p}`").alias(f"..on{k}_{i}") for i, (_, p) in enumerate(pairs)])
        on = None
        for i, (child, _) in enumerate(pairs):
            eq = F.col(f"`{child}`") == F.col(f"`..on{k}_{i}`")
            on = eq if on is None else on & eq
        joined = df.join(right, on, "left").drop(*[f"..on{k}_{i}" for i in range(len(pairs))])
        return joined, (F.col(f"`..parent{k}`"), Binding("iri", prefix), native)
