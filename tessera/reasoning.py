"""Class and property hierarchies: what a query's predicates and classes also match under RDFS."""

from __future__ import annotations

from collections import defaultdict

from .terms import RDF_TYPE, RDFS, Iri

SUB_CLASS, SUB_PROPERTY = RDFS + "subClassOf", RDFS + "subPropertyOf"
#: Entailment regimes by IRI; those from RDFS on are answered by rewriting.
REGIMES = {f"http://www.w3.org/ns/entailment/{x}": x for x in ("Simple", "RDF", "RDFS", "D", "OWL-Direct", "OWL-RDF-Based", "RIF")}


class TBox:
    """The reflexive-transitive closure of subClassOf and subPropertyOf. An ontology is small: it is held on the driver."""

    def __init__(self, triples):
        """triples: (subject IRI, predicate IRI, object IRI) strings."""
        self.down = {SUB_CLASS: defaultdict(set), SUB_PROPERTY: defaultdict(set)}
        for s, p, o in triples:
            if p in self.down:
                self.down[p][o].add(s)
        self._below: dict[tuple[str, str], frozenset[str]] = {}

    @classmethod
    def of(cls, source) -> TBox:
        """From a triple source's hierarchy statements."""
        rows = source.df.where(source.df.p.isin(SUB_CLASS, SUB_PROPERTY)).select("s", "p", "lex").collect()
        return cls([tuple(r) for r in rows])

    @classmethod
    def from_turtle(cls, text: str) -> TBox:
        from .sources.triples import TurtleReader

        return cls([(s.value, p.value, o.value) for s, p, o in TurtleReader(text).triples() if isinstance(s, Iri) and isinstance(o, Iri)])

    def _under(self, relation: str, top: str) -> frozenset[str]:
        key = (relation, top)
        if key not in self._below:
            seen, front = {top}, [top]
            while front:
                for x in self.down[relation].get(front.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        front.append(x)
            self._below[key] = frozenset(seen)
        return self._below[key]

    def sub_classes(self, c: str) -> frozenset[str]:
        """c and everything below it."""
        return self._under(SUB_CLASS, c)

    def sub_properties(self, p: str) -> frozenset[str]:
        return self._under(SUB_PROPERTY, p) if p != RDF_TYPE else frozenset({p})

    def is_sub_class(self, a: str, b: str) -> bool:
        return a in self.sub_classes(b)

    def is_sub_property(self, a: str, b: str) -> bool:
        return a in self.sub_properties(b)
