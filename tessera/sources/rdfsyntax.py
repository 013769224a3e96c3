"""RDF/XML and JSON-LD documents to triples, as rows (s, p, k, lex, dt, lang). Blank nodes are named within a scope."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

from ..terms import BOOLEAN, DOUBLE, INTEGER, LANG_STRING, RDF, RDF_TYPE, STRING

XML = "{http://www.w3.org/XML/1998/namespace}"
XML_LITERAL = RDF + "XMLLiteral"


def _name(tag: str) -> str:
    """The IRI of an element or attribute in ElementTree's form."""
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


class _Writer:
    def __init__(self, scope: str):
        self.scope, self.n, self.rows = scope, 0, []

    def blank(self, label: str | None = None) -> tuple:
        if label is None:
            self.n += 1
            label = f"g{self.n}"
        return "B", f"_:{self.scope}{label}", None, None

    def add(self, s: tuple, p: str, o: tuple) -> None:
        self.rows.append((s[1], p, *o))

    def list_of(self, items: list[tuple]) -> tuple:
        head: tuple = ("I", RDF + "nil", None, None)
        for x in reversed(items):
            cell = self.blank()
            self.add(cell, RDF + "first", x)
            self.add(cell, RDF + "rest", head)
            head = cell
        return head


def _iri(text: str, base: str) -> tuple:
    return "I", urljoin(base, text) if base else text, None, None


def _text(lex: str, lang: str | None = None, dt: str | None = None) -> tuple:
    return "L", lex, dt or (LANG_STRING if lang else STRING), lang.lower() if lang and not dt else None


class _RdfXml(_Writer):
    _own = {RDF + x for x in ("RDF", "Description", "ID", "about", "parseType", "resource", "nodeID", "datatype", "li")}

    def node(self, e: ET.Element, base: str, lang: str | None) -> tuple:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang) or None
        held = {_name(k): v for k, v in e.attrib.items() if not k.startswith(XML)}
        s = _iri(held[RDF + "about"], base) if RDF + "about" in held else _iri(f"#{held[RDF + 'ID']}", base) if RDF + "ID" in held else self.blank(f"n{held[RDF + 'nodeID']}" if RDF + "nodeID" in held else None)
        if _name(e.tag) != RDF + "Description":
            self.add(s, RDF_TYPE, ("I", _name(e.tag), None, None))
        self.attributes(s, held, base, lang)
        count = 0
        for child in e:
            count += _name(child.tag) == RDF + "li"
            self.property(s, child, f"{RDF}_{count}" if _name(child.tag) == RDF + "li" else _name(child.tag), base, lang)
        return s

    def attributes(self, s: tuple, held: dict, base: str, lang: str | None) -> None:
        for p, v in held.items():
            if p not in self._own:
                self.add(s, p, _iri(v, base) if p == RDF_TYPE else _text(v, lang))

    def property(self, s: tuple, e: ET.Element, p: str, base: str, lang: str | None) -> None:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang) or None
        held = {_name(k): v for k, v in e.attrib.items() if not k.startswith(XML)}
        kind, extra = held.get(RDF + "parseType"), {k: v for k, v in held.items() if k not in self._own}
        if kind == "Resource":
            o = self.blank()
            for child in e:
                self.property(o, child, _name(child.tag), base, lang)
        elif kind == "Collection":
            o = self.list_of([self.node(child, base, lang) for child in e])
        elif kind is not None:
            o = _text((e.text or "") + "".join(ET.tostring(child, encoding="unicode") for child in e), dt=XML_LITERAL)
        elif RDF + "resource" in held or RDF + "nodeID" in held or extra and not len(e):
            o = _iri(held[RDF + "resource"], base) if RDF + "resource" in held else self.blank(f"n{held[RDF + 'nodeID']}" if RDF + "nodeID" in held else None)
            self.attributes(o, extra, base, lang)
        elif len(e):
            o = self.node(e[0], base, lang)
        else:
            o = _text(e.text or "", lang, urljoin(base, held[RDF + "datatype"]) if RDF + "datatype" in held else None)
        self.add(s, p, o)
        if RDF + "ID" in held:
            said = _iri(f"#{held[RDF + 'ID']}", base)
            for q, x in (("type", ("I", RDF + "Statement", None, None)), ("subject", s), ("predicate", ("I", p, None, None)), ("object", o)):
                self.add(said, RDF + q, x)


def rdf_xml(text: str, base: str = "", scope: str = "") -> list[tuple]:
    w, root = _RdfXml(scope), ET.fromstring(text)
    base, lang = root.get(XML + "base", base), root.get(XML + "lang")
    for e in root if _name(root.tag) == RDF + "RDF" else [root]:
        w.node(e, base, lang)
    return w.rows


class _JsonLd(_Writer):
    """Documents whose contexts are in them: terms, prefixes, @vocab, @base, @language, coercions and containers."""

    def within(self, ctx: dict, new) -> dict:
        for c in new if isinstance(new, list) else [new]:
            if isinstance(c, str):
                raise ValueError(f"contexts are read from the document only, not from {c}")
            ctx = {"terms": {}} if c is None else {**ctx, "terms": dict(ctx["terms"])}
            for k, v in (c or {}).items():
                if k in ("@vocab", "@base", "@language"):
                    ctx[k] = v
                elif not k.startswith("@"):
                    ctx["terms"][k] = {"@id": v} if isinstance(v, str) else v if v is None else dict(v)
        return ctx

    def expand(self, name: str, ctx: dict, term: bool = True) -> str | None:
        if name.startswith("@"):
            return name
        terms = ctx["terms"]
        if term and name in terms:
            held = terms[name]
            to = None if held is None else held.get("@id", held.get("@reverse", name))
            if to != name:
                return to and self.expand(to, ctx)
        if ":" in name:
            prefix, rest = name.split(":", 1)
            if prefix == "_" or rest.startswith("//"):
                return name
            to = terms.get(prefix) and terms[prefix].get("@id")
            return self.expand(to, ctx) + rest if to else name
        if term:
            return ctx["@vocab"] + name if ctx.get("@vocab") is not None else None
        return urljoin(ctx.get("@base") or "", name)

    def resource(self, name: str, ctx: dict, term: bool = False) -> tuple:
        to = self.expand(name, ctx, term) or self.expand(name, ctx, False)
        return self.blank(f"n{to[2:]}") if to.startswith("_:") else ("I", to, None, None)

    def node(self, o: dict, ctx: dict) -> tuple:
        ctx = self.within(ctx, o["@context"]) if "@context" in o else ctx
        o = {self.expand(k, ctx) if (self.expand(k, ctx) or "").startswith("@") else k: v for k, v in o.items()}
        s = self.resource(o["@id"], ctx) if "@id" in o else self.blank()
        for t in o.get("@type", []) if isinstance(o.get("@type", []), list) else [o["@type"]]:
            self.add(s, RDF_TYPE, self.resource(t, ctx, True))
        for k, v in o.items():
            if k == "@graph":
                self.document(v, ctx)
            elif k == "@reverse":
                for p, xs in v.items():
                    for x in xs if isinstance(xs, list) else [xs]:
                        self.add(self.object(x, {"@type": "@id"}, ctx), self.expand(p, ctx), s)
            elif not k.startswith("@") and v is not None:
                self.property(s, k, v, ctx)
        return s

    def property(self, s: tuple, k: str, v, ctx: dict) -> None:
        held, p = ctx["terms"].get(k) or {}, self.expand(k, ctx)
        if p is None or ":" not in p:
            return
        kind = held.get("@container")
        if kind == "@list" and not (isinstance(v, dict) and "@list" in v):
            v = {"@list": v}
        if kind == "@language" and isinstance(v, dict):
            v = [{"@value": x, "@language": lang} for lang, xs in v.items() for x in (xs if isinstance(xs, list) else [xs])]
        for x in v if isinstance(v, list) else [v]:
            if x is None:
                continue
            if isinstance(x, dict) and "@set" in x:
                self.property(s, k, x["@set"], ctx)
            elif "@reverse" in held:
                self.add(self.object(x, {"@type": "@id"}, ctx), p, s)
            else:
                self.add(s, p, self.object(x, held, ctx))

    def object(self, x, held: dict, ctx: dict) -> tuple:
        kind = held.get("@type")
        if isinstance(x, dict):
            if "@list" in x:
                items = x["@list"] if isinstance(x["@list"], list) else [x["@list"]]
                return self.list_of([self.object(i, held, ctx) for i in items])
            if "@value" not in x:
                return self.node(x, ctx)
            v, lang, dt = x["@value"], x.get("@language"), x.get("@type") and self.expand(x["@type"], ctx)
            return _text(v, lang, dt) if isinstance(v, str) else self.number(v, dt)
        if isinstance(x, str):
            if kind in ("@id", "@vocab"):
                return self.resource(x, ctx, kind == "@vocab")
            dt = kind and self.expand(kind, ctx)
            return _text(x, None if dt else held.get("@language", ctx.get("@language")), dt)
        return self.number(x, kind and self.expand(kind, ctx))

    @staticmethod
    def number(v, dt: str | None) -> tuple:
        if isinstance(v, bool):
            return _text("true" if v else "false", dt=dt or BOOLEAN)
        if isinstance(v, int) or v == int(v) and abs(v) < 1e21 and dt != DOUBLE:
            return _text(str(int(v)), dt=dt or INTEGER)
        mantissa, exponent = f"{v:.15E}".split("E")
        mantissa = mantissa.rstrip("0")
        return _text(f"{mantissa}{'0' if mantissa.endswith('.') else ''}E{int(exponent)}", dt=dt or DOUBLE)

    def document(self, o, ctx: dict) -> None:
        for x in o if isinstance(o, list) else [o]:
            if set(x) <= {"@context", "@graph"}:
                self.document(x.get("@graph", []), self.within(ctx, x["@context"]) if "@context" in x else ctx)
            else:
                self.node(x, ctx)


def json_ld(text: str, base: str = "", scope: str = "") -> list[tuple]:
    w = _JsonLd(scope)
    w.document(json.loads(text), {"terms": {}, "@base": base})
    return w.rows


def parse_files(parse, suffix: str) -> object:
    """For mapInPandas over (path, content, file): each document is read by one task; file names its blank nodes."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for b in batches:
            for path, content, file in zip(b["path"], b["content"], b["file"]):
                data = gzip.decompress(content) if path.endswith(".gz") else content
                rows = parse(bytes(data).decode("utf-8"), path, f"{file}{suffix}")
                yield pd.DataFrame(rows, columns=["s", "p", "k", "lex", "dt", "lang"], dtype=object)

    return run
