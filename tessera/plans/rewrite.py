"""Rewrites of the algebra that need no data: template expansion, and merging of neighbouring groups."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from ..terms import Iri, Term, Var
from . import algebra as A


@dataclass(frozen=True)
class Template:
    """A virtual predicate: the pattern that `subject predicate object` stands for."""

    subject: str
    object: str
    pattern: A.Bgp


class TemplateLoop(ValueError):
    pass


def expand_templates(node, templates: dict[str, Template], depth: int = 32):
    """Every triple with a virtual predicate becomes its pattern, with fresh variables; again in what that brings."""
    numbers = count()

    def expand(triples: list[A.Triple], left: int) -> list[A.Triple]:
        out = []
        for t in triples:
            template = templates.get(t.p.value) if isinstance(t.p, Iri) else None
            if template is None:
                out.append(t)
                continue
            if not left:
                raise TemplateLoop(t.p.value)
            names: dict[str, Term] = {template.subject: t.s, template.object: t.o}

            def fresh(x: Term, names=names) -> Term:
                if not isinstance(x, Var):
                    return x
                if x.name not in names:
                    names[x.name] = Var(f".tpl{next(numbers)}")
                return names[x.name]

            out += expand([A.Triple(fresh(x.s), fresh(x.p), fresh(x.o)) for x in template.pattern.triples], left - 1)
        return out

    return transform(node, lambda n: A.Bgp(expand(n.triples, depth)) if isinstance(n, A.Bgp) else n)


def flatten(node):
    """Nested joins and unions become one; basic patterns of one join become one, which makes their stars whole."""

    def step(n):
        if isinstance(n, A.Join):
            parts: list = []
            for p in n.parts:
                for x in p.parts if isinstance(p, A.Join) else [p]:
                    if isinstance(x, A.Bgp) and (held := next((y for y in parts if isinstance(y, A.Bgp)), None)):
                        held.triples = held.triples + x.triples
                    else:
                        parts.append(A.Bgp(list(x.triples)) if isinstance(x, A.Bgp) else x)
            return parts[0] if len(parts) == 1 else A.Join(parts)
        if isinstance(n, A.Union):
            return A.Union([x for p in n.parts for x in (p.parts if isinstance(p, A.Union) else [p])])
        return n

    return transform(node, step)


def transform(n, f):
    """A copy of the tree with f applied from the leaves up."""
    go = lambda x: transform(x, f)
    cond = lambda e: A.Exists(go(e.pattern), e.negated) if isinstance(e, A.Exists) else e
    if isinstance(n, A.Join):
        n = A.Join([go(p) for p in n.parts])
    elif isinstance(n, A.Union):
        n = A.Union([go(p) for p in n.parts])
    elif isinstance(n, A.LeftJoin):
        n = A.LeftJoin(go(n.left), go(n.right), [cond(e) for e in n.conditions])
    elif isinstance(n, A.Minus):
        n = A.Minus(go(n.left), go(n.right))
    elif isinstance(n, A.Filter):
        n = A.Filter(go(n.part), [cond(e) for e in n.conditions])
    elif isinstance(n, A.Extend):
        n = A.Extend(go(n.part), n.var, n.expr)
    elif isinstance(n, A.Path):
        n = A.Path(n.s, go(n.step), n.start, n.end, n.o, n.least, n.repeat)
    elif isinstance(n, A.Query):
        n = A.Query(**{**n.__dict__, "where": go(n.where), "order": list(n.order)})
    return f(n)
