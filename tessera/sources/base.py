"""What a source answers: stars of triple patterns around one subject."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.relation import Binding, Relation, constant, equal_terms
from ..terms import RDF_TYPE, Blank, Iri, Term, Var


@dataclass(frozen=True)
class Wanted:
    """A triple pattern; `predicates` and `classes` hold a ground predicate's or class's alternatives under a TBox."""

    s: Term
    p: Term
    o: Term
    predicates: frozenset[str] | None
    classes: frozenset[str] | None

    @property
    def is_type(self) -> bool:
        return self.predicates is not None and RDF_TYPE in self.predicates


class Source:
    """A data source. prefixes: what its subjects' IRIs start with ("" for any), None if they are blank nodes."""

    name = "source"
    prefixes: tuple[str, ...] | None = ("",)
    equivalent_to: str | None = None
    required: frozenset[str] = frozenset()
    #: Whether it has bound_star, which joins a star with what is bound before; with required inputs it must.
    binds = False
    #: Whether it answers patterns of several subjects at once.
    groups = False

    def may_match(self, w: Wanted) -> bool:
        raise NotImplementedError

    def star(self, wanted: list[Wanted], needed: set[str]) -> Relation:
        """All patterns of one subject, each on this source."""
        raise NotImplementedError

    def subject_fits(self, s: Term) -> bool:
        if isinstance(s, Iri):
            return self.prefixes is not None and any(s.value.startswith(p) for p in self.prefixes)
        return isinstance(s, (Var, Blank))


def equals_constant(c: Column, b: Binding, t: Term, spark_type: str) -> Column | None:
    """c equals a ground term, as a filter on the native column where that can be; None if it never does."""
    if b.kind == "iri" and isinstance(t, Iri):
        if not t.value.startswith(b.prefix):
            return None
        key = t.value[len(b.prefix):]
        if spark_type in ("tinyint", "smallint", "int", "bigint"):
            return c == F.lit(int(key)) if key.lstrip("-").isdigit() and str(int(key)) == key else None
        return c.cast("string") == F.lit(key)
    return equal_terms(c, b, *constant(t))


class Star:
    """Collects the bindings and conditions of a star over one row."""

    def __init__(self):
        self.names: dict[str, tuple[Column, Binding]] = {}
        self.where: list[Column] = []
        self.possible = True

    def bind(self, t: Term, c: Column, b: Binding, spark_type: str = "string", certain: bool = False) -> None:
        if isinstance(t, Var):
            if t.name not in self.names:
                self.names[t.name] = (c, b)
                if not certain:
                    self.where.append(c.isNotNull())
                return
            eq = equal_terms(*self.names[t.name], c, b)
        else:
            eq = equals_constant(c, b, t, spark_type)
        if eq is None:
            self.possible = False
        else:
            self.where.append(eq)
