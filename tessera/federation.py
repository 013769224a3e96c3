"""Several sources as one graph: the entry point for queries."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from .operators import relation as R
from .operators.relation import Relation
from .plans import algebra as A
from .plans.compiler import Compiler
from .plans.parser import parse
from .plans.rewrite import Template, expand_templates, flatten
from .reasoning import TBox
from .sources.base import Source, Wanted
from .terms import Var


class Federation(Source):
    """Answers SPARQL over its sources; itself a source for another federation.

    dedup_sources: triples that several sources hold count once. on_source_error: "raise", or "empty" to answer
    without a source that fails to compile a pattern.
    """

    def __init__(self, spark: SparkSession, name: str = "federation", dedup_sources: bool = False, on_source_error: str = "raise", strict: bool = False):
        self.spark, self.name, self.dedup, self.strict = spark, name, dedup_sources, strict
        self.on_source_error = on_source_error
        self.sources: list[Source] = []
        self.templates: dict[str, Template] = {}
        self.tbox: TBox | None = None
        self.reasoning = False
        self.timings: dict[str, float] = {}

    @property
    def prefixes(self):
        found = [p for s in self.sources for p in (s.prefixes or ("_:",))]
        return tuple(dict.fromkeys(found)) or ("",)

    def add_source(self, source: Source) -> Federation:
        self.sources.append(source if self.on_source_error == "raise" else _Guarded(source))
        return self

    def index_sources(self) -> None:
        """Lets sources learn what they hold, for source selection."""
        for s in self.sources:
            if hasattr(s, "index"):
                s.index()

    def register_template(self, iri: str, subject: str, object: str, pattern: str) -> None:
        """A virtual predicate: pattern is the text of a group, with ?subject and ?object among its variables."""
        where = parse(f"SELECT * WHERE {{ {pattern} }}").where
        if not isinstance(where, A.Bgp):
            raise ValueError("a template is a basic graph pattern")
        self.templates[iri] = Template(subject, object, where)

    def use_tbox(self, tbox: TBox, always: bool = True) -> None:
        """A hierarchy for queries: for all, or only for those FROM an entailment graph."""
        self.tbox, self.reasoning = tbox, always

    def plan(self, text: str) -> A.Query:
        start = time.perf_counter()
        q = parse(text, self.strict)
        parsed = time.perf_counter()
        q = flatten(expand_templates(flatten(q), self.templates))
        self.timings = {"parse": parsed - start, "rewrite": time.perf_counter() - parsed}
        return q

    def compile(self, q: A.Query) -> Relation:
        start = time.perf_counter()
        tbox = self.tbox if self.reasoning or q.reasoning else None
        self.compiler = Compiler(self.spark, self.sources, tbox, self.dedup)
        out = self.compiler.query(q)
        self.timings["compile"] = time.perf_counter() - start
        return out

    def query(self, text: str, how: str = "native") -> DataFrame:
        """how: native values, "terms" (structs) or "ntriples" (text). ASK gives one row without columns, or none."""
        return R.render(self.compile(self.plan(text)), how)

    def ask(self, text: str) -> bool:
        return not self.compile(self.plan(text)).df.isEmpty()

    def explain(self, text: str) -> str:
        """Which sources answer which patterns, and Spark's plan."""
        q = self.plan(text)
        df = R.render(self.compile(q))
        return "\n".join([*self.compiler.log, df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))])

    # -- as a source

    def may_match(self, w: Wanted) -> bool:
        return any(s.may_match(w) for s in self.sources)

    def star(self, wanted: list[Wanted], needed: set[str]) -> Relation:
        compiler = Compiler(self.spark, self.sources, None, self.dedup)
        compiler.needed = needed | {w.s.name for w in wanted if isinstance(w.s, Var)}
        found = compiler.star(wanted)
        return found if isinstance(found, Relation) else found(Relation(self.spark.range(1).select(), {}))


class _Guarded(Source):
    """A source whose failures count as no data."""

    def __init__(self, inner: Source):
        self.inner, self.name, self.prefixes = inner, inner.name, inner.prefixes
        self.equivalent_to, self.required, self.binds, self.groups = inner.equivalent_to, inner.required, inner.binds, inner.groups

    def may_match(self, w: Wanted) -> bool:
        try:
            return self.inner.may_match(w)
        except Exception as e:  # noqa: BLE001 - asked for by on_source_error="empty"
            print(f"source {self.name} failed: {e}")
            return False

    def index(self) -> None:
        if hasattr(self.inner, "index"):
            self.inner.index()

    def bound_star(self, wanted: list[Wanted], left: Relation, compiler) -> Relation:
        from .sources.table import nothing

        try:
            return self.inner.bound_star(wanted, left, compiler)
        except Exception as e:  # noqa: BLE001 - as above
            print(f"source {self.name} failed: {e}")
            return R.join(left, nothing(SparkSession.active(), wanted))

    def star(self, wanted: list[Wanted], needed: set[str]) -> Relation:
        from .sources.table import nothing

        try:
            return self.inner.star(wanted, needed)
        except Exception as e:  # noqa: BLE001 - asked for by on_source_error="empty"
            print(f"source {self.name} failed: {e}")
            return nothing(SparkSession.active(), wanted)
