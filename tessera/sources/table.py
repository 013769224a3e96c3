"""Tables as triples: a star of patterns on a mapped table is one scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import relation as R
from ..operators.relation import TERMS, Binding, Relation, as_term
from ..terms import OWL, RDF_TYPE, Iri, Var
from .base import Source, Star, Wanted


@dataclass(frozen=True)
class Field:
    """A predicate's object for each row: a column expression (null: no triple) of one shape."""

    predicate: str
    column: Column
    binding: Binding
    spark_type: str


@dataclass
class Mapping:
    """How a table's rows become triples.

    subject: the key's column expression, with its IRI prefix; None for a blank node per row. unique: whether the key
    names one row; where it doesn't, patterns of a star may be answered by different rows, so they are joined.
    """

    types: list[str] = field(default_factory=list)
    subject: Column | None = None
    prefix: str = ""
    subject_type: str = "string"
    fields: list[Field] = field(default_factory=list)
    unique: bool = True


class TableSource(Source):
    def __init__(self, df: DataFrame, mapping: Mapping, name: str):
        self.df, self.mapping, self.name = df, mapping, name
        self.prefixes = None if mapping.subject is None else (mapping.prefix,)
        self.types = mapping.types or ([] if mapping.fields else [OWL + "Thing"])
        self.predicates = {f.predicate for f in mapping.fields} | ({RDF_TYPE} if self.types else set())

    def may_match(self, w: Wanted) -> bool:
        if not self.subject_fits(w.s):
            return False
        if w.predicates is None:
            return True
        if w.is_type and w.classes is not None:
            return bool(w.classes & set(self.types))
        return bool(w.predicates & self.predicates)

    def star(self, wanted: list[Wanted], needed: set[str]) -> Relation:
        if len(wanted) > 1 and self.mapping.subject is not None and not self.mapping.unique:
            return reduce(R.join, [self.star([w], needed | {v.name for v in (w.s,) if isinstance(v, Var)}) for w in wanted])
        options = [self._options(w) for w in wanted]
        made = [x for choice in product(*options) if (x := self._scan(wanted, choice, needed)) is not None]
        return R.union(made) if made else self._nothing(wanted)

    def _options(self, w: Wanted) -> list:
        """What can answer a pattern: a field, a class, or (None) any of them."""
        if w.predicates is None:
            return [None]
        out: list = [f for f in self.mapping.fields if f.predicate in w.predicates]
        if w.is_type:
            out += [t for t in self.types if w.classes is None or t in w.classes]
        return out

    def _scan(self, wanted: list[Wanted], choice: tuple, needed: set[str]) -> Relation | None:
        m, star, df = self.mapping, Star(), self.df
        s = wanted[0].s
        if m.subject is not None:
            star.bind(s, m.subject, Binding("iri", m.prefix), m.subject_type)
        elif isinstance(s, Var) and s.name in needed:
            df = df.withColumn("..row", F.monotonically_increasing_id())
            star.bind(s, F.col("`..row`"), Binding("iri", f"_:{self.name}-"), "bigint", certain=True)
        elif not isinstance(s, Var):
            return None
        for k, (w, option) in enumerate(zip(wanted, choice)):
            if isinstance(option, str):
                if w.classes is None:
                    star.bind(w.o, F.lit(option), Binding("iri"), certain=True)
            elif option is not None:
                star.bind(w.o, option.column, option.binding, option.spark_type)
            else:
                # All properties of a row at once: one scan, whatever their number.
                entries = [F.struct(F.lit(f.predicate).alias("p"), as_term(f.column, f.binding).alias("o")) for f in m.fields]
                entries += [F.struct(F.lit(RDF_TYPE).alias("p"), as_term(F.lit(t), Binding("iri")).alias("o")) for t in self.types]
                df = df.withColumn(f"..all{k}", F.explode(F.filter(F.array(*entries), lambda e: e["o"].isNotNull())))
                star.bind(w.p, F.col(f"`..all{k}`")["p"], Binding("iri"), certain=True)
                star.bind(w.o, F.col(f"`..all{k}`")["o"], TERMS, certain=True)
            if not star.possible:
                return None
        if star.where:
            df = df.where(reduce(lambda a, b: a & b, star.where))
        names = star.names or {}
        once = isinstance(s, Var) and (m.unique or m.subject is None) and None not in choice
        return Relation(df.select(*[c.alias(v) for v, (c, _) in names.items()]), {v: b for v, (_, b) in names.items()}, frozenset({s.name} & set(names)) if once else frozenset())

    def _nothing(self, wanted: list[Wanted]) -> Relation:
        return nothing(self.df.sparkSession, wanted)


def nothing(spark, wanted: list[Wanted]) -> Relation:
    names = list(dict.fromkeys(t.name for w in wanted for t in (w.s, w.p, w.o) if isinstance(t, Var)))
    return Relation(spark.createDataFrame([], ", ".join(f"`{v}` string" for v in names) or "`..none` string").select(*[f"`{v}`" for v in names]), {v: Binding("iri") for v in names})


def _key(columns: list[str], separator: str, df: DataFrame) -> tuple[Column, str]:
    kinds = dict(df.dtypes)
    if len(columns) == 1:
        return F.col(f"`{columns[0]}`"), kinds[columns[0]]
    parts = [F.col(f"`{c}`").cast("string") for c in columns]
    return F.concat(*[x for p in parts for x in (F.lit(separator), p)][1:]), "string"


def from_context(df: DataFrame, context: dict, name: str, links: dict[str, str] | None = None, unique: bool = True) -> TableSource:
    """A table mapped by a JSON-LD context document.

    Inside `@context`: `@type` (class or classes), `@uriProperty` (a column, several, `@blank`, `@GenerateUri`), and
    the predicate of each column. Beside it: `@instancePrefix` (or `@resourceDomain`), `@uriPropertySeparator`,
    `@fallbackPrefix` for unmapped columns (null: leave them out). links: prefix of the IRI that a column's value names.
    """
    inner = context["@context"]
    kinds = dict(df.dtypes)
    types = inner.get("@type", [])
    types = [types] if isinstance(types, str) else list(types)
    prefix = context.get("@instancePrefix", context.get("@resourceDomain")) or ""
    ids = inner.get("@uriProperty", "@blank")
    subject, subject_type = None, "string"
    if ids == "@GenerateUri":
        df = df.withColumn("..seq", F.monotonically_increasing_id())
        subject, subject_type = F.col("`..seq`"), "bigint"
    elif ids != "@blank":
        columns = [ids] if isinstance(ids, str) else list(ids)
        subject, subject_type = _key(columns, context.get("@uriPropertySeparator", "-"), df)
    fallback = context.get("@fallbackPrefix", "urn:plain:")
    fields = []
    for c, kind in kinds.items():
        predicate = inner.get(c) or (fallback + c if fallback is not None else None)
        if predicate is None or kind.startswith(("array", "struct", "map")):
            continue
        column = F.col(f"`{c}`")
        if links and c in links:
            fields.append(Field(predicate, column, Binding("iri", links[c]), kind))
        elif kind == "binary":
            fields.append(Field(predicate, F.hex(column), Binding("lit", dt="http://www.w3.org/2001/XMLSchema#hexBinary"), "string"))
        else:
            fields.append(Field(predicate, column, Binding("lit", dt=R.natural_datatype(kind)), kind))
    return TableSource(df, Mapping(types, subject, prefix, subject_type, fields, unique), name)
