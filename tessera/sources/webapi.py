"""JSON Web APIs: one request per bound input, paging, a rate limit; a source with required inputs (a bind join)."""

from __future__ import annotations

import json
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F

from ..functions.expressions import str_of
from ..operators import relation as R
from ..operators.relation import Binding, Relation
from ..plans.algebra import Expr
from ..terms import STRING, Iri, Lit, Var
from .base import Source, Wanted
from .table import TableSource, from_context


def expand_uri(template: str, values: dict[str, str | None]) -> str:
    """RFC 6570 expansion of {x}, {+x}, {/x}, {?x,y} and {&x,y}; unbound names vanish."""

    def one(m: re.Match) -> str:
        op, names = m[1], m[2].split(",")
        held = [(n, urllib.parse.quote(str(values[n]), safe=":/?#[]@!$&'()*+,;=" if op == "+" else "")) for n in names if values.get(n) is not None]
        if not held:
            return ""
        if op in ("?", "&"):
            return op + "&".join(f"{n}={v}" for n, v in held)
        return ("/" if op == "/" else "") + ("/" if op == "/" else ",").join(v for _, v in held)

    return re.sub(r"\{([+/?&]?)([\w,]+)\}", one, template)


def member(item: dict, path: str):
    """A member by its path (`a.b`); null where an object on the way is missing.

    Of HAL documents, what `_embedded` holds counts as the object's own, and a link is its address.
    """
    for key in path.split("."):
        if not isinstance(item, dict):
            return None
        if key not in item and isinstance(item.get("_embedded"), dict) and key in item["_embedded"]:
            item = item["_embedded"]
        elif key not in item and isinstance(item.get("_links"), dict) and key in item["_links"]:
            link = item["_links"][key]
            item = {key: link.get("href") if isinstance(link, dict) else link}
        item = item.get(key)
    return item


def fetch(url: str) -> str:
    with urllib.request.urlopen(url, timeout=30) as r:  # noqa: S310 - the configured API
        return r.read().decode()


@dataclass
class Api:
    """template: the URI; inputs: template names by the predicate that gives their value; columns: members read, with
    Spark types, by their path; items: path to the list of items in a response; page: name of the page parameter, from first_page on,
    until an empty page; serializers: how inputs are written; interval: least seconds between a task's requests; filters: parameters
    that restrict a predicate's values by an operator, as (predicate, operator) by name, and those of them that a request needs.
    They take the constants of the query's filters that imply them; the query's filters are applied all the same."""

    template: str
    inputs: dict[str, str]
    columns: dict[str, str]
    items: list[str] = field(default_factory=list)
    page: str | None = None
    first_page: int = 1
    page_step: int = 1
    interval: float = 0.0
    get: Callable[[str], str] = fetch
    serializers: dict[str, Callable[[str], str]] = field(default_factory=dict)
    filters: dict[str, tuple[str, str]] = field(default_factory=dict)
    needed: frozenset[str] = frozenset()


#: What a parameter's operator is implied by: an API that keeps values >= 3 may be asked for a query that wants > 3.
IMPLIED = {">=": (">=", ">", "="), ">": (">",), "<=": ("<=", "<", "="), "<": ("<",), "=": ("=",)}
_TURNED = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "="}


def restricted(api: Api, wanted: list[Wanted], filters: list) -> dict[str, str]:
    """The filter parameters' values, from comparisons of the star's variables with constants."""
    out: dict[str, str] = {}
    for name, (predicate, op) in api.filters.items():
        names = {w.o.name for w in wanted if w.predicates and predicate in w.predicates and isinstance(w.o, Var)}
        for e in filters:
            if not (isinstance(e, Expr) and e.name in _TURNED and len(e.args) == 2):
                continue
            (a, b), said = e.args, e.name
            if isinstance(b, Var):
                a, b, said = b, a, _TURNED[said]
            if isinstance(a, Var) and a.name in names and isinstance(b, Lit) and said in IMPLIED[op]:
                out.setdefault(name, b.lex)
    lacking = api.needed - out.keys()
    if lacking:
        raise ValueError(f"{api.template} needs filters for {sorted(lacking)}")
    return out


class WebApiSource(Source):
    """Items of a JSON API as a mapped table; inputs come from what the query has bound before, or from its constants."""

    def __init__(self, spark, api: Api, context: dict, name: str):
        self.spark, self.api, self.context, self.name = spark, api, context, name
        schema = ", ".join(f"`{c}` {t}" for c, t in {**{n: "string" for n in api.inputs.values()}, **api.columns}.items())
        self.schema = schema
        self.shape: TableSource = from_context(spark.createDataFrame([], schema), context, name, unique=False)
        self.required = frozenset(api.inputs)
        self.prefixes = self.shape.prefixes

    def may_match(self, w: Wanted) -> bool:
        return bool(w.predicates and w.predicates & self.required) or self.shape.may_match(w)

    def rows(self, inputs, restrictions: dict[str, str] | None = None):
        """The items for each row of inputs (a column per template name); equal inputs are asked once.

        restrictions: values of the filter parameters, the same for all rows.
        """
        fixed = {n: self.api.serializers[n](v) if n in self.api.serializers else v for n, v in (restrictions or {}).items()}
        api, names = self.api, list(self.api.inputs.values())
        fields = list(dict.fromkeys([*names, *api.columns]))

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last = 0.0
            for b in batches:
                for row in b.to_dict("records"):
                    page, out, before = api.first_page, [], None
                    while True:
                        time.sleep(max(0.0, last + api.interval - time.monotonic()))
                        last = time.monotonic()
                        sent = {n: api.serializers[n](v) if n in api.serializers else v for n, v in row.items()}
                        data = json.loads(api.get(expand_uri(api.template, sent | fixed | ({api.page: page} if api.page else {}))))
                        for key in api.items:
                            data = member(data, key) or []
                        items = data if isinstance(data, list) else [data]
                        if api.page and items and items == before:
                            raise ValueError(f"{api.template} answers every page alike: does it know {api.page}?")
                        before = items
                        out += [{**{c: member(i, c) for c in api.columns}, **{n: row[n] for n in names}} for i in items]
                        if not api.page or not items:
                            break
                        page += api.page_step
                    if out:
                        yield pd.DataFrame(out)[fields]

        return inputs.distinct().mapInPandas(ask, ", ".join(f"`{f}` {api.columns.get(f, 'string')}" for f in fields))

    def bound_star(self, wanted: list[Wanted], left: Relation, compiler) -> Relation:
        """left joined with the star, for the inputs that left binds or the patterns state.

        An input's pattern holds for what was asked: answers come back to the rows that asked, by the input's text.
        """
        texts, stars = {}, []
        asked = {}
        for predicate, name in self.api.inputs.items():
            w = next((w for w in wanted if w.predicates and predicate in w.predicates), None)
            if w is None or isinstance(w.o, Var) and w.o.name not in left.vars:
                raise ValueError(f"{self.name} needs a bound value of {predicate}")
            texts[name] = str_of((left.col(w.o.name), left.vars[w.o.name])) if isinstance(w.o, Var) else F.lit(w.o.lex if hasattr(w.o, "lex") else w.o.value)
            asked[w] = name
        for w in wanted:
            if w in asked:
                hidden = "urn:input:" + asked[w]
                w = Wanted(w.s, Iri(hidden), Var(f".in {asked[w]}"), frozenset({hidden}), None)
            stars.append(w)
        cols = [left.col(v).alias(v) for v in left.vars] + [c.alias(f".in {n}") for n, c in texts.items()]
        asking = Relation(left.df.select(*cols), left.vars | {f".in {n}": Binding("lit", dt=STRING) for n in texts})
        context = self.context | {"@context": self.context["@context"] | {n: f"urn:input:{n}" for n in texts}}
        limits = restricted(self.api, wanted, compiler.filters)
        table = from_context(self.rows(asking.df.select(*[F.col(f"`.in {n}`").alias(n) for n in texts]), limits), context, self.name, unique=False)
        table.mapping.unique = True  # an item is a row; its patterns belong together
        needed = compiler.needed | {w.s.name for w in wanted if isinstance(w.s, Var)}
        out = R.join(asking, table.star(stars, needed))
        return R.project(out, [v for v in out.vars if not v.startswith(".in ")])

    def star(self, wanted: list[Wanted], needed: set[str]) -> Relation:
        raise ValueError(f"{self.name} needs bound inputs")


