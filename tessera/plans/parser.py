"""SPARQL 1.1 SELECT and ASK queries to the algebra, by recursive descent.

`strict` rejects what lies beyond the basic language (grouping, ordering, OFFSET, BIND, MINUS, EXISTS, inverse,
alternative and repeated paths, sub-queries); by default these extensions are computed.
"""

from __future__ import annotations

import re
from itertools import count

from ..terms import BOOLEAN, DECIMAL, DOUBLE, INTEGER, LANG_STRING, RDF, RDF_TYPE, STRING, Blank, Iri, Lit, Term, Var
from . import algebra as A

TOKEN = re.compile(
    r"""(?P<space>[\s]+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<var>[?$]\w+)
    |(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)|(?P<number>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
    |(?P<blank>_:[\w][\w.-]*)|(?P<name>(?:[A-Za-z_\u00c0-\uffff][\w.-]*)?:(?:[\w:%-](?:[\w:%.-]*[\w:%-])?)?)|(?P<word>[A-Za-z_]\w*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,*/|^?+!=<>-])""",
    re.X | re.S,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}
#: FROM with one of these graphs asks for entailment.
ENTAILMENT = "http://www.w3.org/ns/entailment/"


class ParseError(ValueError):
    pass


def unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        return chr(int(x[1:], 16)) if x[0] in "uU" else ESCAPES[x]

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[tnrbf\"'\\])", one, s)


def string_value(token: str) -> str:
    n = 3 if token[:3] in ('"""', "'''") and len(token) >= 6 else 1
    return unescape(token[n:-n])


class Tokens:
    """The tokens of a text with look-ahead; words are matched without regard to case."""

    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected {text[at:at + 20]!r} at {at}")
            if m.lastgroup != "space":
                self.items.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def next(self) -> tuple[str, str]:
        item = self.peek()
        self.at += 1
        return item

    def word(self) -> str:
        kind, text = self.peek()
        return text.upper() if kind == "word" else ""

    def take(self, *texts: str) -> str | None:
        kind, text = self.peek()
        text = text.upper() if kind == "word" else text
        if text in texts and kind in ("word", "op"):
            self.at += 1
            return text
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise ParseError(f"expected {text}, found {self.peek()[1]!r}")


class TermReader:
    """IRIs, prefixed names and literals, shared with the Turtle reader."""

    def __init__(self, tokens: Tokens, base: str = ""):
        self.t, self.base = tokens, base
        self.prefixes: dict[str, str] = {}
        self.labels = count()

    def iri(self) -> Iri:
        kind, text = self.t.next()
        if kind == "iri":
            value = unescape(text[1:-1])
            return Iri(value if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value) else self.base + value)
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix in self.prefixes:
                return Iri(self.prefixes[prefix] + local.replace("\\", ""))
            raise ParseError(f"unknown prefix {prefix}:")
        raise ParseError(f"expected an IRI, found {text!r}")

    def prologue(self) -> None:
        while True:
            at = self.t.peek()[0] == "lang" and self.t.peek()[1].lower() in ("@prefix", "@base")
            word = self.t.peek()[1].lower().lstrip("@") if at else self.t.word().lower()
            if word == "prefix":
                self.t.next()
                name = self.t.next()[1]
                self.prefixes[name.rstrip(":")] = self.iri().value
            elif word == "base":
                self.t.next()
                self.base = self.iri().value
            else:
                return
            if at:
                self.t.need(".")

    def literal(self) -> Lit | None:
        kind, text = self.t.peek()
        if kind == "string":
            self.t.next()
            value = string_value(text)
            if self.t.peek()[0] == "lang":
                return Lit(value, LANG_STRING, self.t.next()[1][1:].lower())
            return Lit(value, self.iri().value) if self.t.take("^^") else Lit(value, STRING)
        sign = text if kind == "op" and text in "+-" and self.t.peek(1)[0] == "number" else ""
        if kind == "number" or sign:
            self.t.at += bool(sign)
            number = self.t.next()[1]
            dt = DOUBLE if "e" in number.lower() else DECIMAL if "." in number else INTEGER
            return Lit((sign if sign == "-" else "") + number, dt)
        if self.t.word() in ("TRUE", "FALSE"):
            return Lit(self.t.next()[1].lower(), BOOLEAN)
        return None

    def fresh(self) -> str:
        return f".b{next(self.labels)}"


class Parser(TermReader):
    def __init__(self, text: str, strict: bool = False):
        super().__init__(Tokens(text))
        self.strict = strict

    def extension(self, what: str) -> None:
        if self.strict:
            raise ParseError(f"{what} is not part of the basic language")

    # -- query forms

    def query(self) -> A.Query:
        self.prologue()
        q = self.select_query()
        if self.t.peek()[0] != "end":
            raise ParseError(f"unexpected {self.t.peek()[1]!r} after the query")
        return q

    def select_query(self) -> A.Query:
        form = self.t.word()
        if form not in ("SELECT", "ASK"):
            raise ParseError(f"{self.t.peek()[1]!r}: only SELECT and ASK queries are supported")
        self.t.next()
        q = A.Query(form, A.Bgp())
        if form == "SELECT":
            q.distinct = bool(self.t.take("DISTINCT", "REDUCED"))
            if not self.t.take("*"):
                q.select = []
                while True:
                    if self.t.peek()[0] == "var":
                        q.select.append((self.var(), None))
                    elif self.t.take("("):
                        self.extension("(expression AS ?var)")
                        e = self.expression()
                        self.t.need("AS")
                        q.select.append((self.var(), e))
                        self.t.need(")")
                    else:
                        break
                if not q.select:
                    raise ParseError("SELECT needs variables or *")
        while self.t.take("FROM"):
            self.t.take("NAMED")
            q.reasoning |= self.iri().value.startswith(ENTAILMENT)
        self.t.take("WHERE")
        q.where = self.group()
        self.modifiers(q)
        if self.t.take("VALUES"):
            q.where = A.Join([q.where, self.values()])
        if self.strict and q.select is not None and (missing := [v for v, e in q.select if e is None and v not in A.variables(q.where)]):
            raise ParseError(f"not bound by any pattern: {missing}")
        return q

    def modifiers(self, q: A.Query) -> None:
        if self.t.take("GROUP"):
            self.extension("GROUP BY")
            self.t.need("BY")
            while True:
                if self.t.peek()[0] == "var":
                    v = self.var()
                    q.group.append((v, Var(v)))
                elif self.t.take("("):
                    e = self.expression()
                    q.group.append((self.var() if self.t.take("AS") else self.fresh(), e))
                    self.t.need(")")
                else:
                    break
        if self.t.take("HAVING"):
            self.extension("HAVING")
            while self.t.peek()[1] == "(":
                q.having.append(self.bracketed())
        if self.t.take("ORDER"):
            self.extension("ORDER BY")
            self.t.need("BY")
            while True:
                way = self.t.take("ASC", "DESC")
                if way:
                    q.order.append((self.bracketed(), way == "ASC"))
                elif self.t.peek()[0] == "var":
                    q.order.append((Var(self.var()), True))
                elif self.t.peek()[1] == "(":
                    q.order.append((self.bracketed(), True))
                else:
                    break
        while word := self.t.take("LIMIT", "OFFSET"):
            kind, n = self.t.next()
            if kind != "number" or not n.isdigit():
                raise ParseError(f"{word} needs a number")
            if word == "OFFSET":
                self.extension("OFFSET")
                q.offset = int(n)
            else:
                q.limit = int(n)

    def var(self) -> str:
        kind, text = self.t.next()
        if kind != "var":
            raise ParseError(f"expected a variable, found {text!r}")
        return text[1:]

    # -- patterns

    def group(self) -> A.Node:
        """A group: parts are joined in order; filters hold for the whole group."""
        self.t.need("{")
        if self.t.word() == "SELECT":
            self.extension("a sub-query")
            q = self.select_query()
            self.t.need("}")
            return q
        node: A.Node = A.Join([])
        filters: list = []

        def add(x: A.Node) -> None:
            nonlocal node
            if not isinstance(node, A.Join):
                node = A.Join([node])
            if isinstance(x, A.Bgp) and node.parts and isinstance(node.parts[-1], A.Bgp):
                node.parts[-1].triples += x.triples
            else:
                node.parts.append(x)

        while not self.t.take("}"):
            word = self.t.word()
            if self.t.take("FILTER"):
                filters.append(self.condition())
            elif self.t.take("OPTIONAL"):
                right = self.group()
                # Filters of the optional group may speak of variables outside: they are conditions of the join.
                conditions = right.conditions if isinstance(right, A.Filter) else []
                right = right.part if isinstance(right, A.Filter) else right
                node = A.LeftJoin(self.single(node), right, conditions)
            elif self.t.take("MINUS"):
                self.extension("MINUS")
                node = A.Minus(self.single(node), self.group())
            elif self.t.take("BIND"):
                self.extension("BIND")
                self.t.need("(")
                e = self.expression()
                self.t.need("AS")
                node = A.Extend(self.single(node), self.var(), e)
                self.t.need(")")
            elif self.t.take("VALUES"):
                add(self.values())
            elif word in ("SERVICE", "GRAPH"):
                raise ParseError(f"{word} is not supported")
            elif self.t.peek()[1] == "{":
                parts = [self.group()]
                while self.t.take("UNION"):
                    parts.append(self.group())
                add(A.Union(parts) if len(parts) > 1 else parts[0])
            else:
                for x in self.triples():
                    add(x)
            self.t.take(".")
        node = self.single(node)
        return A.Filter(node, filters) if filters else node

    @staticmethod
    def single(node: A.Node) -> A.Node:
        return node.parts[0] if isinstance(node, A.Join) and len(node.parts) == 1 else node

    def values(self) -> A.Values:
        one = self.t.peek()[0] == "var"
        names = []
        if one:
            names = [self.var()]
        else:
            self.t.need("(")
            while not self.t.take(")"):
                names.append(self.var())
        self.t.need("{")
        rows = []
        while not self.t.take("}"):
            if not one:
                self.t.need("(")
            row = []
            while len(row) < len(names):
                row.append(None if self.t.take("UNDEF") else self.literal() or self.iri())
            if not one:
                self.t.need(")")
            rows.append(row)
        return A.Values(names, rows)

    def triples(self) -> list[A.Node]:
        out: list[A.Node] = []
        bracket = self.t.peek()[1] == "["
        s = self.node(out)
        if not (bracket and self.t.peek()[1] in ".}"):
            self.properties(s, out)
        return self.merged(out)

    @staticmethod
    def merged(nodes: list[A.Node]) -> list[A.Node]:
        flat = A.Bgp([t for n in nodes if isinstance(n, A.Bgp) for t in n.triples])
        return ([flat] if flat.triples else []) + [n for n in nodes if not isinstance(n, A.Bgp)]

    def properties(self, s: Term, out: list[A.Node]) -> None:
        while True:
            path = Var(self.var()) if self.t.peek()[0] == "var" else self.path()
            while True:
                o = self.node(out)
                out.extend(self.walk(s, path, o))
                if not self.t.take(","):
                    break
            while self.t.take(";"):
                pass
            if self.t.peek()[1] in (".", "}", "]", "") or self.t.word() in ("FILTER", "OPTIONAL", "MINUS", "BIND", "VALUES"):
                return
            if self.t.items[self.t.at - 1][1] != ";":
                return

    def node(self, out: list[A.Node]) -> Term:
        kind, text = self.t.peek()
        if kind == "var":
            return Var(self.var())
        if kind == "blank":
            self.t.next()
            return Var("._" + text[2:])
        if self.t.take("["):
            v = Var(self.fresh())
            if not self.t.take("]"):
                self.properties(v, out)
                self.t.need("]")
            return v
        if self.t.take("("):
            items = []
            while not self.t.take(")"):
                items.append(self.node(out))
            head: Term = Iri(RDF + "nil")
            for x in reversed(items):
                cell = Var(self.fresh())
                out.append(A.Bgp([A.Triple(cell, Iri(RDF + "first"), x), A.Triple(cell, Iri(RDF + "rest"), head)]))
                head = cell
            return head
        return self.literal() or self.iri()

    # -- paths: ("iri", x), ("seq", a, b), ("alt", a, b), ("inv", a), ("rep", a, least, many)

    def path(self) -> tuple:
        out = self.path_sequence()
        while self.t.take("|"):
            self.extension("an alternative path")
            out = ("alt", out, self.path_sequence())
        return out

    def path_sequence(self) -> tuple:
        out = self.path_step()
        while self.t.take("/"):
            out = ("seq", out, self.path_step())
        return out

    def path_step(self) -> tuple:
        if self.t.take("^"):
            self.extension("an inverse path")
            return ("inv", self.path_step())
        if self.t.peek()[1] == "!":
            raise ParseError("negated property sets are not supported")
        if self.t.take("("):
            out = self.path()
            self.t.need(")")
        elif self.t.peek() == ("word", "a"):
            self.t.next()
            out = ("iri", Iri(RDF_TYPE))
        else:
            out = ("iri", self.iri())
        if many := self.t.take("*", "+", "?"):
            self.extension("a repeated path")
            out = ("rep", out, 1 if many == "+" else 0, many != "?")
        return out

    def walk(self, s: Term, path, o: Term) -> list[A.Node]:
        if isinstance(path, Var):
            return [A.Bgp([A.Triple(s, path, o)])]
        if path[0] == "iri":
            return [A.Bgp([A.Triple(s, path[1], o)])]
        if path[0] == "inv":
            return self.walk(o, path[1], s)
        if path[0] == "seq":
            mid = Var(self.fresh())
            return self.merged(self.walk(s, path[1], mid) + self.walk(mid, path[2], o))
        if path[0] == "alt":
            return [A.Union([self.single(A.Join(self.walk(s, p, o))) for p in path[1:]])]
        a, b = self.fresh(), self.fresh()
        return [A.Path(s, self.single(A.Join(self.walk(Var(a), path[1], Var(b)))), a, b, o, path[2], path[3])]

    # -- expressions

    def condition(self):
        negated = self.t.word() == "NOT"
        if negated or self.t.word() == "EXISTS":
            self.extension("EXISTS")
            self.t.at += negated
            self.t.need("EXISTS")
            return A.Exists(self.group(), negated)
        return self.bracketed() if self.t.peek()[1] == "(" else self.primary()

    def bracketed(self):
        self.t.need("(")
        e = self.expression()
        self.t.need(")")
        return e

    def expression(self):
        return self.binary(["||"], lambda: self.binary(["&&"], self.relation))

    def binary(self, ops: list[str], below):
        out = below()
        while op := self.t.take(*ops):
            out = A.Expr(op, (out, below()))
        return out

    def relation(self):
        left = self.sum()
        if op := self.t.take("=", "!=", "<", ">", "<=", ">="):
            return A.Expr(op, (left, self.sum()))
        if negated := self.t.take("NOT"):
            self.t.need("IN")
        if negated or self.t.take("IN"):
            e = A.Expr("in", (left, *self.arguments()))
            return A.Expr("!", (e,)) if negated else e
        return left

    def sum(self):
        return self.binary(["+", "-"], lambda: self.binary(["*", "/"], self.unary))

    def unary(self):
        if self.t.take("!"):
            return A.Expr("!", (self.unary(),))
        if self.t.peek()[1] in ("+", "-") and self.t.peek(1)[0] != "number":
            return A.Expr("neg" if self.t.next()[1] == "-" else "pos", (self.unary(),))
        return self.primary()

    def arguments(self) -> list:
        self.t.need("(")
        out = []
        while not self.t.take(")"):
            out.append(self.expression())
            self.t.take(",")
        return out

    def primary(self):
        kind, text = self.t.peek()
        if text == "(":
            return self.bracketed()
        if kind == "var":
            return Var(self.var())
        if (lit := self.literal()) is not None:
            return lit
        if kind in ("iri", "name"):
            iri = self.iri()
            return A.Expr(iri.value, tuple(self.arguments())) if self.t.peek()[1] == "(" else iri
        if kind == "word":
            self.t.next()
            name = text.upper()
            if name in AGGREGATES:
                self.extension(name)
                self.t.need("(")
                distinct = bool(self.t.take("DISTINCT"))
                arg = None if self.t.take("*") else self.expression()
                sep = " "
                if self.t.take(";"):
                    self.t.need("SEPARATOR")
                    self.t.need("=")
                    sep = string_value(self.t.next()[1])
                self.t.need(")")
                return A.Aggregate(name, arg, distinct, sep)
            if name in ("EXISTS", "NOT"):
                self.t.at -= 1
                return self.condition()
            return A.Expr(name.lower(), tuple(self.arguments()))
        raise ParseError(f"unexpected {text!r} in an expression")


def parse(text: str, strict: bool = False) -> A.Query:
    return Parser(text, strict).query()
