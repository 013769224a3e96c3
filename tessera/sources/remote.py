"""Remote SPARQL endpoints: whole stars in one request, or bind joins that send what is bound in VALUES batches."""

from __future__ import annotations

import csv
import io
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..operators import relation as R
from ..operators.relation import TERM, TERMS, Relation, as_term, ntriples_text
from ..terms import BOOLEAN, DECIMAL, DOUBLE, INTEGER, LANG_STRING, RDF_TYPE, STRING, Blank, Iri, Term, Var
from .base import Source, Wanted

ACCEPT = "text/tab-separated-values, application/sparql-results+json;q=0.8, text/csv;q=0.4"
#: Bindings that one request carries.
BATCH = 40
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?\Z', re.S)
_NUMBER = ((re.compile(r"[+-]?[0-9]+\Z"), INTEGER), (re.compile(r"[+-]?[0-9]*\.[0-9]+\Z"), DECIMAL), (re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]+\Z"), DOUBLE))


def parse_term(text: str) -> tuple | None:
    """A term of a TSV result as (k, lex, dt, lang); None if it is unbound."""
    if not text:
        return None
    if text[0] == "<":
        return "I", text[1:-1], None, None
    if text.startswith("_:"):
        return "B", text, None, None
    m = _LITERAL.match(text)
    if m:
        plain = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
        lex = _ESCAPE.sub(lambda e: chr(int(e[1] or e[2], 16)) if e[1] or e[2] else plain.get(e[3], e[3]), m[1])
        lex = lex.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        return ("L", lex, LANG_STRING, m[2].lower()) if m[2] else ("L", lex, m[3] or STRING, None)
    if text in ("true", "false"):
        return "L", text, BOOLEAN, None
    return "L", text, next((dt for form, dt in _NUMBER if form.match(text)), STRING), None


def _json_term(t: dict | None) -> tuple | None:
    if t is None:
        return None
    if t["type"] in ("uri", "bnode"):
        return ("I", t["value"], None, None) if t["type"] == "uri" else ("B", f"_:{t['value']}", None, None)
    lang = t.get("xml:lang")
    return "L", t["value"], LANG_STRING if lang else t.get("datatype") or STRING, lang.lower() if lang else None


def parse_rows(media: str, body: Iterator[str], names: list[str]) -> Iterator[list]:
    """The terms of the named variables, row by row, from a result in TSV, JSON or CSV (whose values are IRIs or text)."""
    if "json" in media:
        for row in json.loads("".join(body))["results"]["bindings"]:
            yield [_json_term(row.get(v)) for v in names]
        return
    if "csv" in media:
        lines = csv.reader(io.StringIO("".join(body), newline=""))
        head = next(lines)
        for row in lines:
            if row or len(head) <= 1:
                held = dict(zip(head, row))
                yield [None if not held.get(v) else ("I", held[v], None, None) if re.match(r"[a-z][a-z0-9+.-]*:\S*\Z", held[v]) else ("B", held[v], None, None) if held[v].startswith("_:") else ("L", held[v], STRING, None) for v in names]
        return
    head = None
    for line in body:
        cells = line.rstrip("\n").split("\t")
        if head is None:
            head = [c.strip().lstrip("?$") for c in cells]
            continue
        held = dict(zip(head, cells))
        yield [parse_term(held.get(v, "").strip()) for v in names]


def request(url: str, query: str, timeout: float = 60.0, tries: int = 3) -> tuple[str, Iterator[str]]:
    """(media type, lines of the body) of a query, by GET, or POST where it is long; failing servers are asked again."""
    data = urllib.parse.urlencode({"query": query})
    for turn in range(tries):
        try:
            if len(data) < 4000:
                r = urllib.request.Request(f"{url}{'&' if '?' in url else '?'}{data}", headers={"Accept": ACCEPT})
            else:
                r = urllib.request.Request(url, data.encode(), {"Accept": ACCEPT, "Content-Type": "application/x-www-form-urlencoded"})
            answer = urllib.request.urlopen(r, timeout=timeout)  # noqa: S310 - the configured endpoint
            return answer.headers.get("Content-Type", ""), io.TextIOWrapper(answer, "utf-8", newline="\n")
        except urllib.error.HTTPError as e:
            if e.code < 500 or turn == tries - 1:
                raise RuntimeError(f"{url} answered {e.code}: {e.read().decode(errors='replace')[:500]}") from e
        except OSError:
            if turn == tries - 1:
                raise
        time.sleep(0.5 * 2**turn)
    raise AssertionError


def term_text(t: Term) -> str:
    """A term in SPARQL. Blank nodes of a pattern are variables there."""
    if isinstance(t, Iri):
        return f"<{t.value}>"
    if isinstance(t, Var):
        return f"?{t.name}"
    if isinstance(t, Blank):
        return f"_:{t.label}"
    lex = t.lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f'"{lex}"' + (f"@{t.lang}" if t.lang else "" if t.dt == STRING else f"^^<{t.dt}>")


class SparqlSource(Source):
    """An endpoint as a source.

    describe: "select" lists predicates and classes once (index); "ask" asks once for each kind of pattern whether it
    has any triple; None sends every pattern. binds: stars that share variables with what is bound before are asked
    for those bindings only, BATCH a request, by at most `parallel` tasks.
    """

    groups = True

    def __init__(self, spark, url: str, name: str = "remote", describe: str | None = "ask", binds: bool = True, batch: int = BATCH, parallel: int = 2, prefixes: tuple[str, ...] = ("",), timeout: float = 60.0):
        self.spark, self.url, self.name, self.describe, self.binds, self.batch, self.parallel = spark, url, name, describe, binds, batch, parallel
        self.prefixes, self.timeout = prefixes, timeout
        self.known: set[str] | None = None
        self.classes: set[str] | None = None
        self._asked: dict[str, bool] = {}

    # -- what it holds

    def index(self) -> None:
        self.known = {r[0][1] for r in self._rows("SELECT DISTINCT ?p WHERE { ?s ?p ?o }", ["p"])}
        self.classes = {r[0][1] for r in self._rows(f"SELECT DISTINCT ?c WHERE {{ ?s <{RDF_TYPE}> ?c }}", ["c"])}

    def _rows(self, query: str, names: list[str]) -> list[list]:
        return list(parse_rows(*request(self.url, query, self.timeout), names))

    def ask(self, query: str) -> bool:
        if query not in self._asked:
            self._asked[query] = bool(self._rows(re.sub(r"^ASK", "SELECT *", query) + " LIMIT 1", []))
        return self._asked[query]

    def may_match(self, w: Wanted) -> bool:
        if self.describe == "select":
            if self.known is None:
                self.index()
            if w.predicates is None:
                return True
            if w.is_type and w.classes is not None:
                return bool(w.classes & self.classes)
            return bool(w.predicates & self.known)
        if self.describe == "ask" and w.predicates is not None:
            objects = [term_text(Iri(c)) for c in sorted(w.classes)] if w.is_type and w.classes is not None else ["?o"]
            return any(self.ask(f"ASK {{ ?s <{p}> {o} }}") for p in sorted(w.predicates) for o in objects)
        return True

    # -- what it answers

    def _pattern(self, wanted: list[Wanted]) -> tuple[str, list[str]]:
        """The text of the star's patterns, and their variables."""
        parts, names = [], []
        for i, w in enumerate(wanted):
            p, o = term_text(w.p), term_text(w.o)
            if w.predicates is not None and len(w.predicates) > 1:
                p = f"?p__{i}"
                parts.append(f"VALUES {p} {{ {' '.join(f'<{x}>' for x in sorted(w.predicates))} }}")
            if w.is_type and w.classes is not None and len(w.classes) > 1:
                o = f"?c__{i}"
                parts.append(f"VALUES {o} {{ {' '.join(f'<{x}>' for x in sorted(w.classes))} }}")
            parts.append(f"{term_text(w.s)} {p} {o} .")
            names += [t.name for t in (w.s, w.p, w.o) if isinstance(t, Var)]
        return " ".join(parts), list(dict.fromkeys(names))

    def _fetched(self, queries, names: list[str]) -> Relation:
        """queries: a DataFrame of `q`, asked where they are; the rows of all answers."""
        url, timeout = self.url, self.timeout

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for q in b["q"]:
                    held = []
                    for row in parse_rows(*request(url, q, timeout), names):
                        held.append([None if t is None else dict(zip(("k", "lex", "dt", "lang"), t)) for t in row])
                        if len(held) == 10_000:
                            yield pd.DataFrame(held, columns=names, dtype=object)
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=names, dtype=object)

        df = queries.mapInPandas(ask, ", ".join(f"`{v}` {TERM}" for v in names))
        return Relation(df, {v: TERMS for v in names})

    def star(self, wanted: list[Wanted], needed: set[str]) -> Relation:
        text, names = self._pattern(wanted)
        if not names:  # ground: a row, or none
            one = self._fetched(self.spark.createDataFrame([(f"SELECT ?x__ WHERE {{ {text} VALUES ?x__ {{ 1 }} }} LIMIT 1",)], "q string"), ["x__"])
            return Relation(one.df.select(), {})
        return self._fetched(self.spark.createDataFrame([(f"SELECT {' '.join(f'?{v}' for v in names)} WHERE {{ {text} }}",)], "q string"), names)

    def bound_star(self, wanted: list[Wanted], left: Relation, compiler) -> Relation:
        """left joined with the star: its distinct bindings of the shared variables go out in VALUES batches."""
        text, names = self._pattern(wanted)
        shared = [v for v in names if v in left.vars]
        if not self.binds or not shared:
            return R.join(left, self.star(wanted, compiler.needed))
        cells = [F.coalesce(F.when(t["k"] != "B", ntriples_text(t)), F.when(t.isNull(), F.lit("UNDEF"))) for t in (as_term(left.col(v), left.vars[v]) for v in shared)]
        rows = left.df.select(F.concat(F.lit("("), F.concat_ws(" ", *cells), F.lit(")")).alias("r"), F.size(F.array_compact(F.array(*cells))).alias("n"))
        rows = rows.where(F.col("n") == len(shared)).select("r").distinct().coalesce(self.parallel)  # blank nodes have no name outside
        head, batch = f"SELECT {' '.join(f'?{v}' for v in names)} WHERE {{ VALUES ({' '.join(f'?{v}' for v in shared)}) {{ ", self.batch

        def batched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[str] = []
            for b in batches:
                held += b["r"].tolist()
                full = len(held) // batch * batch
                if full:
                    yield pd.DataFrame({"q": [f"{head}{' '.join(held[i : i + batch])} }} {text} }}" for i in range(0, full, batch)]})
                    held = held[full:]
            if held:
                yield pd.DataFrame({"q": [f"{head}{' '.join(held)} }} {text} }}"]})

        found = self._fetched(rows.mapInPandas(batched, "q string"), names)
        # All of the star's variables are there, so that its solutions are a set; unbound ones may have asked for some twice.
        return R.join(left, R.distinct(found))
