"""The query tree: patterns, groups and modifiers, before any DataFrame exists."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..terms import Term, Var


@dataclass(frozen=True)
class Triple:
    s: Term
    p: Term
    o: Term

    def vars(self) -> list[str]:
        return [t.name for t in (self.s, self.p, self.o) if isinstance(t, Var)]


@dataclass(frozen=True)
class Expr:
    """A call of an operator or function; a leaf is a term."""

    name: str
    args: tuple = ()

    def vars(self) -> set[str]:
        out: set[str] = set()
        for a in self.args:
            if isinstance(a, Var):
                out.add(a.name)
            elif isinstance(a, Expr):
                out |= a.vars()
        return out


@dataclass
class Node:
    pass


@dataclass
class Bgp(Node):
    triples: list[Triple] = field(default_factory=list)


@dataclass
class Path(Node):
    """s path o, with one or more steps (`+`) or also none (`*`, `?`)."""

    s: Term
    step: Node
    start: str
    end: str
    o: Term
    least: int
    repeat: bool


@dataclass
class Join(Node):
    parts: list[Node]


@dataclass
class LeftJoin(Node):
    left: Node
    right: Node
    conditions: list[Expr] = field(default_factory=list)


@dataclass
class Union(Node):
    parts: list[Node]


@dataclass
class Minus(Node):
    left: Node
    right: Node


@dataclass
class Filter(Node):
    part: Node
    conditions: list


@dataclass
class Exists:
    """A FILTER [NOT] EXISTS condition."""

    pattern: Node
    negated: bool


@dataclass
class Extend(Node):
    part: Node
    var: str
    expr: object


@dataclass
class Values(Node):
    vars: list[str]
    rows: list[list]


@dataclass
class Aggregate:
    name: str
    arg: object
    distinct: bool = False
    separator: str = " "


@dataclass
class Query:
    form: str
    where: Node
    select: list[tuple[str, object]] | None = None
    distinct: bool = False
    group: list[tuple[str, object]] = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list[tuple[object, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    reasoning: bool = False


def variables(node: Node) -> list[str]:
    """Names bound by a node, in order of appearance; hidden ones (starting with `.`) left out."""
    out: dict[str, None] = {}

    def visit(n) -> None:
        if isinstance(n, Bgp):
            for t in n.triples:
                out.update(dict.fromkeys(t.vars()))
        elif isinstance(n, Path):
            out.update(dict.fromkeys(t.name for t in (n.s, n.o) if isinstance(t, Var)))
        elif isinstance(n, (Join, Union)):
            for p in n.parts:
                visit(p)
        elif isinstance(n, LeftJoin):
            visit(n.left)
            visit(n.right)
        elif isinstance(n, (Minus,)):
            visit(n.left)
        elif isinstance(n, Filter):
            visit(n.part)
        elif isinstance(n, Extend):
            visit(n.part)
            out[n.var] = None
        elif isinstance(n, Values):
            out.update(dict.fromkeys(n.vars))
        elif isinstance(n, Query):
            out.update(dict.fromkeys([v for v, _ in n.select] if n.select is not None else variables(n.where)))

    visit(node)
    return [v for v in out if not v.startswith(".")]
