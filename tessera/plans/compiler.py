"""From the algebra to relations: source selection per star, then joins, filters and modifiers as DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import pairs as P
from ..operators import relation as R
from ..operators.relation import TERMS, Binding, Relation
from ..runtime import written
from ..sources.base import Source, Wanted
from ..sources.table import nothing
from ..terms import DECIMAL, DOUBLE, INTEGER, RDF_TYPE, STRING, Iri, Var
from . import algebra as A


def _compatible(a: Source, b: Source) -> bool:
    """Whether the two may describe one subject."""
    if a is b:
        return True
    if a.prefixes is None or b.prefixes is None:
        return False
    return any(p.startswith(q) or q.startswith(p) for p in a.prefixes for q in b.prefixes)


#: Steps that a path follows from a ground end one by one; beyond, what is left of the graph is closed by doubling.
STEPS = 12


def _closure(edges):
    """All pairs that edges (a, b) connect: new pairs join all pairs until none is new; each round is written."""
    pairs = fresh = written(edges)
    while not fresh.isEmpty():
        more = fresh.alias("l").join(pairs.alias("r"), F.col("l.b") == F.col("r.a")).select(F.col("l.a").alias("a"), F.col("r.b").alias("b")).distinct()
        fresh = written(more.join(pairs, ["a", "b"], "left_anti"))
        pairs = pairs.union(fresh)
    return pairs


class Compiler:
    def __init__(self, spark, sources: list[Source], tbox=None, dedup_sources: bool = False):
        self.spark, self.sources, self.tbox, self.dedup = spark, sources, tbox, dedup_sources
        self.needed: set[str] = set()
        self.filters: list = []  # the conditions that hold for what is being compiled, for sources that can use them
        self.log: list[str] = []

    # -- queries

    def query(self, q: A.Query) -> Relation:
        self.needed = self._needed(q)
        return self.select(q)

    def select(self, q: A.Query) -> Relation:
        r = self.node(q.where)
        if q.form == "ASK":
            return Relation(r.df.limit(1).select(), {})
        aggregated = bool(q.group) or bool(q.having) or any(_has_aggregate(e) for _, e in q.select or [])
        if aggregated:
            r = self.grouped(q, r)
        else:
            for v, e in q.select or []:
                if e is not None:
                    r = self.extend(r, v, e)
        names = [v for v, _ in q.select] if q.select is not None else A.variables(q.where)
        order = [(e, up) for e, up in q.order]
        if order and not q.distinct:
            r = self.ordered(r, order)
        r = R.project(r, names)
        if q.distinct:
            r = R.distinct(r)
            r = self.ordered(r, order) if order else r
        df = r.df
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Relation(df, r.vars)

    def ordered(self, r: Relation, order: list) -> Relation:
        keys = []
        for e, up in order:
            c, b = E.evaluate(e, self.names(r))
            parts = [E.number((c, b))[0], c["lex"]] if b.kind == "term" else [R.iri_text(c, b) if b.kind == "iri" else c]
            keys += [k.asc_nulls_first() if up else k.desc_nulls_last() for k in parts]
        return Relation(r.df.orderBy(*keys), r.vars)

    def grouped(self, q: A.Query, r: Relation) -> Relation:
        names = self.names(r)
        keys = {v: E.evaluate(e, names) for v, e in q.group}
        found: dict[str, tuple] = {}

        def replaced(e):
            """Aggregates become variables."""
            if isinstance(e, A.Aggregate):
                v = f".agg{len(found)}"
                found[v] = aggregate(e, names)
                return Var(v)
            return A.Expr(e.name, tuple(map(replaced, e.args))) if isinstance(e, A.Expr) else e

        outs = [(v, replaced(e)) for v, e in q.select or [] if e is not None]
        having = [replaced(e) for e in q.having]
        q.order = [(replaced(e), up) for e, up in q.order]
        shapes = {v: b for v, (_, b) in keys.items()} | {v: b for v, (_, b) in found.items()}
        cols = [c.alias(v) for v, (c, _) in found.items()] or [F.count(F.lit(1)).alias(".n")]
        df = r.df.groupBy(*[c.alias(v) for v, (c, _) in keys.items()]).agg(*cols)
        out = Relation(df.select(*[F.col(f"`{v}`") for v in shapes]), shapes)
        for e in having:
            out = self.where(out, e)
        for v, e in outs:
            out = self.extend(out, v, e)
        return out

    # -- nodes

    def node(self, n: A.Node) -> Relation:
        return getattr(self, f"_{type(n).__name__.lower()}")(n)

    def _query(self, n: A.Query) -> Relation:
        held, self.filters = self.filters, []
        try:
            return self.select(n)
        finally:
            self.filters = held

    def _join(self, n: A.Join) -> Relation:
        if not n.parts:
            return Relation(self.spark.range(1).select(), {})
        return self.joined([self.node(p) for p in n.parts])

    def joined(self, rels: list[Relation]) -> Relation:
        """In an order that avoids products: the next one shares a variable with those before, where one does."""
        left, rest = rels[0], list(rels[1:])
        while rest:
            k = next((i for i, r in enumerate(rest) if set(r.vars) & set(left.vars)), None)
            left = self.product(left, rest.pop(0)) if k is None else P.join(left, rest.pop(k))
        return left

    def product(self, left: Relation, right: Relation) -> Relation:
        """A product, without some of the pairs that a comparison around it drops."""
        equal = False
        for e in self.filters:
            if not isinstance(e, A.Expr) or e.name not in ("=", "<", "<=", ">", ">=") or _varies(e):
                continue
            sides = [{a.name} if isinstance(a, Var) else a.vars() if isinstance(a, A.Expr) else set() for a in e.args]
            for x, y in ((0, 1), (1, 0)):
                if not (sides[x] and sides[y] and sides[x] <= set(left.vars) and sides[y] <= set(right.vars)):
                    continue
                if e.name == "=":
                    equal = True  # Catalyst makes it the join's key
                elif (values := E.ordered(E.evaluate(e.args[x], self.names(left)), E.evaluate(e.args[y], self.names(right)))) is not None:
                    a, b = values
                    return P.range_join(left, right, a, b) if (e.name[0] == "<") == (x == 0) else P.range_join(left, right, P.reversed_order(a), P.reversed_order(b))
        return R.join(left, right) if equal else P.join(left, right)

    def _leftjoin(self, n: A.LeftJoin) -> Relation:
        left = self.node(n.left) if not (isinstance(n.left, A.Join) and not n.left.parts) else Relation(self.spark.range(1).select(), {})
        condition = None
        if n.conditions:
            condition = lambda names: reduce(lambda a, b: a & b, [E.condition(e, names) for e in n.conditions])
        return R.left_join(left, self.node(n.right), condition)

    def _union(self, n: A.Union) -> Relation:
        return R.union([self.node(p) for p in n.parts])

    def _minus(self, n: A.Minus) -> Relation:
        return R.semi_join(self.node(n.left), self._apart(n.right), True, True)

    def _apart(self, part: A.Node) -> Relation:
        """A part that the filters around it don't restrict."""
        held, self.filters = self.filters, []
        try:
            return self.node(part)
        finally:
            self.filters = held

    def _filter(self, n: A.Filter) -> Relation:
        held, self.filters = self.filters, [*self.filters, *n.conditions]
        try:
            r = self.node(n.part)
        finally:
            self.filters = held
        for e in n.conditions:
            r = self.where(r, e)
        return r

    def where(self, r: Relation, e) -> Relation:
        if isinstance(e, A.Exists):
            return R.semi_join(r, self._apart(e.pattern), e.negated, False)
        return Relation(r.df.where(E.condition(e, self.names(r))), r.vars, r.keys)

    def _extend(self, n: A.Extend) -> Relation:
        return self.extend(self.node(n.part), n.var, n.expr)

    def extend(self, r: Relation, v: str, e) -> Relation:
        c, b = E.evaluate(e, self.names(r))
        kept = [r.col(x).alias(x) for x in r.vars if x != v]
        return Relation(r.df.select(*kept, c.alias(v)), {x: y for x, y in r.vars.items() if x != v} | {v: b.maybe()})

    def _values(self, n: A.Values) -> Relation:
        r = R.values(self.spark, n.vars, n.rows)
        return Relation(F.broadcast(r.df), r.vars)  # as large as the query's text

    @staticmethod
    def names(r: Relation) -> dict:
        return {v: (r.col(v), b) for v, b in r.vars.items()}

    def _path(self, n: A.Path) -> Relation:
        """Pairs that the step connects, over any number of steps if it repeats; each round is written.

        From a ground end only what it reaches is followed. Between free ends new pairs join all pairs until none is
        new, so that lengths double. Steps of no length connect every term of the graph with itself.
        """
        self.needed |= {n.start, n.end}
        step = self.node(n.step)
        iris = all(step.vars[v].kind == "iri" for v in (n.start, n.end)) and not (n.least == 0 and isinstance(n.s, Var) and isinstance(n.o, Var))
        key = (lambda v, r: R.iri_text(r.col(v), r.vars[v])) if iris else (lambda v, r: R.term_key(R.as_term(r.col(v), r.vars[v])))
        ground = lambda t: None if isinstance(t, Var) else F.lit(t.value if isinstance(t, Iri) else None) if iris else R.term_key(R.term_of(t))
        edges = step.df.select(key(n.start, step).alias("a"), key(n.end, step).alias("b")).distinct()
        first, last = ground(n.s), ground(n.o)
        if n.repeat and (first is not None or last is not None):
            edges = written(edges)
            a, b = ("a", "b") if first is not None else ("b", "a")  # follow from the ground end
            pairs = fresh = written(edges.where(F.col(a) == (first if first is not None else last)))
            for _ in range(STEPS):
                if fresh.isEmpty():
                    break
                more = fresh.alias("l").join(edges.alias("r"), F.col(f"l.{b}") == F.col(f"r.{a}")).select(F.col(f"l.{a}").alias(a), F.col(f"r.{b}").alias(b)).distinct()
                fresh = written(more.join(pairs, ["a", "b"], "left_anti").select("a", "b"))
                pairs = pairs.union(fresh)
            else:  # a long way: what isn't followed yet is closed by doubling
                done = pairs.select(F.col(b).alias(a)).join(fresh.select(F.col(b).alias(a)), a, "left_anti").distinct()
                rest = _closure(edges.join(done, a, "left_anti").select("a", "b"))
                more = fresh.alias("l").join(rest.alias("r"), F.col(f"l.{b}") == F.col(f"r.{a}")).select(F.col(f"l.{a}").alias(a), F.col(f"r.{b}").alias(b))
                pairs = pairs.union(more.select("a", "b")).distinct()
        elif n.repeat:
            pairs = _closure(edges)
        else:
            pairs = edges
        if n.least == 0:
            ends = [x for x in (first, last) if x is not None]
            nodes = reduce(lambda x, y: x.union(y), [self.spark.range(1).select(x.alias("a")) for x in ends]) if ends else self._terms()
            pairs = pairs.union(nodes.select("a", F.col("a").alias("b"))).distinct()
        for x, c in ((first, "a"), (last, "b")):
            if x is not None:
                pairs = pairs.where(F.col(c) == x)
        names = {t.name: F.col(c) for t, c in ((n.o, "b"), (n.s, "a")) if isinstance(t, Var)}
        if isinstance(n.s, Var) and n.s == n.o:
            pairs = pairs.where("a = b")
        shape = Binding("iri") if iris else TERMS
        return Relation(pairs.select(*[(c if iris else R.term_of_key(c)).alias(v) for v, c in names.items()]), {v: shape for v in names})

    def _terms(self):
        """(a): the key of every term that is a subject or an object in some source that can be scanned."""
        s, p, o = Var(".s"), Var(".p"), Var(".o")
        self.needed |= {".s", ".p", ".o"}
        every = self.star([self.wanted(A.Triple(s, p, o))])
        every = every if isinstance(every, Relation) or any(x.required for x in self.sources) else every(Relation(self.spark.range(1).select(), {}))
        if not isinstance(every, Relation):
            raise ValueError("a path of no length between free ends needs sources that can be scanned")
        return reduce(lambda x, y: x.union(y), [every.df.select(R.term_key(R.as_term(every.col(v), every.vars[v])).alias("a")) for v in (".s", ".o")]).distinct()

    # -- basic graph patterns

    def wanted(self, t: A.Triple) -> Wanted:
        predicates = classes = None
        if isinstance(t.p, Iri):
            predicates = frozenset({t.p.value} | (self.tbox.sub_properties(t.p.value) if self.tbox else set()))
            if t.p.value == RDF_TYPE and isinstance(t.o, Iri):
                classes = frozenset({t.o.value} | (self.tbox.sub_classes(t.o.value) if self.tbox else set()))
        return Wanted(t.s, t.p, t.o, predicates, classes)

    def _bgp(self, n: A.Bgp) -> Relation:
        stars: dict = {}
        for t in dict.fromkeys(n.triples):
            stars.setdefault(t.s, []).append(self.wanted(t))
        if not stars:
            return Relation(self.spark.range(1).select(), {})
        stars = self._exclusive(stars)
        # Stars with a ground term first: what they bind keeps the later joins small.
        ground = lambda ws: -sum(not isinstance(t, Var) for w in ws for t in (w.s, w.o))
        bound = [s for ws in stars.values() for s in [self.star(ws)]]
        order = sorted(range(len(bound)), key=lambda i: (self._needs_input(list(stars.values())[i]), ground(list(stars.values())[i]), i))
        return self.joined_sources([bound[i] for i in order])

    def _exclusive(self, stars: dict) -> dict:
        """Stars that share variables and that only one endpoint answers go to it together."""
        out: dict = {}
        for s, ws in stars.items():
            found = {c for w in ws for c in self.candidates(w)}
            one = next(iter(found)) if len(found) == 1 and all(self.candidates(w) for w in ws) else None
            if one is None or not one.groups:
                out[s] = ws
                continue
            names = lambda xs: {t.name for w in xs for t in (w.s, w.p, w.o) if isinstance(t, Var)}
            group = list(ws)
            for key in [k for k in out if isinstance(k, tuple) and k[0] is one and names(out[k]) & names(ws)]:
                group = out.pop(key) + group
            out[(one, s)] = group
        return out

    def _needs_input(self, ws: list[Wanted]) -> int:
        """0: none; 1: it can use what is bound before; 2: it must."""
        found = [s for w in ws for s in self.candidates(w)]
        return 2 if any(s.required for s in found) else int(any(s.binds for s in found))

    def joined_sources(self, rels: list) -> Relation:
        """Joins; a star on a source with required inputs is a function of what is bound before it."""
        ready = [r for r in rels if isinstance(r, Relation)]
        left = self.joined(ready) if ready else Relation(self.spark.range(1).select(), {})
        for call in rels:
            if not isinstance(call, Relation):
                left = call(left)
        return left

    def candidates(self, w: Wanted) -> list[Source]:
        found = [s for s in self.sources if s.may_match(w)]
        names = {s.name for s in found}
        return [s for s in found if s.equivalent_to not in names]

    def star(self, ws: list[Wanted]):
        """A subject's patterns: sources that can't share a subject are asked apart, each for the whole star."""
        cands = [self.candidates(w) for w in ws]
        every = list(dict.fromkeys(s for c in cands for s in c))
        self.log.append(f"{ws[0].s}: " + "; ".join(f"{w.p} -> {[s.name for s in c]}" for w, c in zip(ws, cands)))
        groups: list[list[Source]] = []
        for s in every:
            near = [g for g in groups if any(_compatible(s, x) for x in g)]
            groups = [g for g in groups if g not in near] + [[x for g in near for x in g] + [s]]
        answers = []
        for g in groups:
            own = [[s for s in c if s in g] for c in cands]
            if not all(own):
                continue
            if len(g) == 1 and (g[0].required or g[0].binds and len(groups) == 1):
                return lambda left, s=g[0]: s.bound_star(ws, left, self)
            answers.append(g[0].star(ws, self.needed) if len(g) == 1 else self.mixed(ws, own))
        if not answers:
            return nothing(self.spark, ws)
        return answers[0] if len(answers) == 1 else R.union(answers)

    def mixed(self, ws: list[Wanted], own: list[list[Source]]) -> Relation:
        """Patterns that only one source answers go to it together; others are unions over their sources."""
        needed = self.needed | {w.s.name for w in ws if isinstance(w.s, Var)}
        exclusive: dict[Source, list[Wanted]] = {}
        parts = []
        for w, sources in zip(ws, own):
            if len(sources) == 1:
                exclusive.setdefault(sources[0], []).append(w)
            else:
                r = R.union([s.star([w], needed) for s in sources])
                parts.append(R.distinct(r) if self.dedup else r)
        return self.joined([s.star(group, needed) for s, group in exclusive.items()] + parts)

    def _needed(self, q: A.Query) -> set[str]:
        """Variables that something beside their own star's subject uses."""
        uses: dict[str, int] = {}

        def use(names, n=1):
            for v in names:
                uses[v] = uses.get(v, 0) + n

        def expr(e):
            if isinstance(e, Var):
                use([e.name], 2)
            elif isinstance(e, A.Expr):
                use(e.vars(), 2)
                for a in e.args:
                    expr(a)
            elif isinstance(e, A.Aggregate):
                expr(e.arg)
            elif isinstance(e, A.Exists):
                visit(e.pattern)

        def visit(n):
            if isinstance(n, A.Bgp):
                for s in {t.s for t in n.triples if isinstance(t.s, Var)}:
                    use([s.name])
                for t in n.triples:
                    use([x.name for x in (t.p, t.o) if isinstance(x, Var)], 2)
            elif isinstance(n, A.Query):
                use([v for v, _ in n.select] if n.select is not None else A.variables(n.where), 2)
                for _, e in n.select or []:
                    expr(e)
                for e, _ in n.order:
                    expr(e)
                for _, e in n.group:
                    expr(e)
                for e in n.having:
                    expr(e)
                visit(n.where)
            elif isinstance(n, A.Path):
                use([t.name for t in (n.s, n.o) if isinstance(t, Var)], 2)
                use([n.start, n.end], 2)
                visit(n.step)
            else:
                for x in ("left", "right", "part"):
                    if hasattr(n, x):
                        visit(getattr(n, x))
                for x in getattr(n, "parts", []):
                    visit(x)
                for e in getattr(n, "conditions", []):
                    expr(e)
                if isinstance(n, A.Extend):
                    expr(n.expr)
                if isinstance(n, A.Values):
                    use(n.vars, 2)

        visit(q)
        return {v for v, k in uses.items() if k > 1}


def _varies(e) -> bool:
    """Whether an expression may have another value when it is evaluated again."""
    return isinstance(e, A.Expr) and (e.name in ("rand", "now", "uuid", "struuid", "bnode") or any(map(_varies, e.args)))


def _has_aggregate(e) -> bool:
    return isinstance(e, A.Aggregate) or isinstance(e, A.Expr) and any(map(_has_aggregate, e.args))


def aggregate(a: A.Aggregate, names: dict):
    if a.arg is None:
        if a.distinct:
            return F.count_distinct(F.struct(*[c for c, _ in names.values()])), Binding("lit", dt=INTEGER)
        return F.count(F.lit(1)), Binding("lit", dt=INTEGER)
    c, b = E.evaluate(a.arg, names)
    if a.name == "COUNT":
        return (F.count_distinct(c) if a.distinct else F.count(c)), Binding("lit", dt=INTEGER)
    if a.name in ("SUM", "AVG"):
        n, t = E.number((c, b))
        f = {("SUM", False): F.sum, ("SUM", True): F.sum_distinct, ("AVG", False): F.avg, ("AVG", True): lambda x: F.sum_distinct(x) / F.count_distinct(x)}[a.name, a.distinct]
        # A value that isn't a number makes the aggregate an error, which is unbound; over no values it is 0.
        out = F.when(F.count(c) > F.count(n), F.lit(None)).otherwise(F.coalesce(f(n), F.lit(0)))
        return out, Binding("lit", dt=t if a.name == "SUM" and t else DECIMAL if t in (INTEGER, DECIMAL) else DOUBLE)
    if a.name == "GROUP_CONCAT":
        s = E.str_of((c, b))
        items = F.collect_set(s) if a.distinct else F.collect_list(s)
        return F.array_join(F.array_sort(items), a.separator), Binding("lit", dt=STRING)
    if a.name == "SAMPLE":
        return F.first(c, ignorenulls=True), b
    if b.kind == "term":
        f = F.min_by if a.name == "MIN" else F.max_by
        return f(c, F.struct(E.number((c, b))[0], c["lex"])), TERMS
    return (F.min if a.name == "MIN" else F.max)(R.iri_text(c, b) if b.kind == "iri" else c), Binding("iri") if b.kind == "iri" else b
