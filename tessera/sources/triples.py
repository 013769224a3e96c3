"""Triple stores: DataFrames of (s, p, k, lex, dt, lang), read from N-Triples, Turtle or Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relation as R
from ..operators.relation import TERMS, Binding, Relation
from ..plans import parser as P
from ..terms import LANG_STRING, RDF, RDF_TYPE, STRING, Blank, Iri, Lit, Term, Var
from .base import Source, Star, Wanted
from .rdfsyntax import json_ld, parse_files, rdf_xml

SCHEMA = "s string, p string, k string, lex string, dt string, lang string"


#: Alternatives of a predicate or class that are listed in a filter; more are a broadcast semi-join.
MOST_ALTERNATIVES = 200


def _among(df: DataFrame, column: str, values) -> DataFrame:
    listed = df.sparkSession.createDataFrame([(v,) for v in sorted(values)], f"{column} string")
    return df.join(F.broadcast(listed), column, "left_semi")  # as long as the hierarchy that the driver holds


class TripleSource(Source):
    """Any triples. The sets of predicates and classes are learned by `index`, else every pattern may match."""

    def __init__(self, df: DataFrame, name: str):
        self.df, self.name = df, name
        self.known: set[str] | None = None
        self.classes: set[str] | None = None

    def index(self) -> None:
        """Collects the predicates and the classes in use: their number is that of a vocabulary."""
        self.known = {r["p"] for r in self.df.select("p").distinct().collect()}
        self.classes = {r["lex"] for r in self.df.where(F.col("p") == RDF_TYPE).select("lex").distinct().collect()}

    def may_match(self, w: Wanted) -> bool:
        if w.predicates is None or self.known is None:
            return True
        if w.is_type and w.classes is not None and self.classes is not None:
            return bool(w.classes & self.classes)
        return bool(w.predicates & self.known)

    def star(self, wanted: list[Wanted], needed: set[str]) -> Relation:
        return reduce(R.join, [self._pattern(w) for w in wanted])

    def _pattern(self, w: Wanted) -> Relation:
        star, held = Star(), self.df
        object_ = F.struct("k", "lex", "dt", "lang")
        star.bind(w.s, F.col("s"), Binding("iri"), certain=True)
        if w.predicates is None:
            star.bind(w.p, F.col("p"), Binding("iri"), certain=True)
        elif len(w.predicates) > MOST_ALTERNATIVES:
            held = _among(held, "p", w.predicates)
        else:
            star.where.append(F.col("p").isin(*sorted(w.predicates)))
        if w.is_type and w.classes is not None:
            star.where.append(F.col("k") == "I")
            if len(w.classes) > MOST_ALTERNATIVES:
                held = _among(held, "lex", w.classes)
            else:
                star.where.append(F.col("lex").isin(*sorted(w.classes)))
        elif isinstance(w.o, Var):
            star.bind(w.o, object_, TERMS, certain=True)
        else:
            kind, t = ("I", w.o.value) if isinstance(w.o, Iri) else ("L", w.o.lex)
            star.where += [F.col("k") == kind, F.col("lex") == t]
            if isinstance(w.o, Lit):
                star.where += [F.col("dt") == w.o.dt, F.col("lang").eqNullSafe(F.lit(w.o.lang).cast("string"))]
        df = held.where(reduce(lambda a, b: a & b, star.where)) if star.where else held
        return Relation(df.select(*[c.alias(v) for v, (c, _) in star.names.items()]), {v: b for v, (_, b) in star.names.items()})


def read_ntriples(spark: SparkSession, paths, malformed: str = "raise") -> DataFrame:
    """N-Triples and N-Quads files (whose graphs are merged), compressed or not, split over tasks.

    Blank labels stay distinct per read by the file's name. malformed: what a line that is no triple does, "raise" or "skip".
    """
    # A literal ends at the first quote that isn't escaped; no loop of the pattern nests, whatever the literal's length.
    line = r'(?s)^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:[^\s.]\S*|".*?"(?<=(?<!\\)(?:\\\\){0,50}")(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(?:<[^>]*>\s*|_:\S+\s+)?\.\s*(?:#.*)?$'
    rows = spark.read.text(paths).where(~F.col("value").rlike(r"^\s*(?:#.*)?$")).select("value", F.xxhash64(F.col("_metadata.file_path")).alias("file"))
    rows = rows.select(*[F.regexp_extract("value", line, i).alias(n) for i, n in ((1, "rs"), (2, "p"), (3, "ro"))], "file", "value")
    bad = F.raise_error(F.concat(F.lit("not a triple: "), F.substring("value", 1, 200))).cast("string")
    rows = rows.withColumn("p", F.when(F.col("p") == "", bad).otherwise(F.col("p"))) if malformed == "raise" else rows.where("p <> ''")
    label = lambda c: F.concat(F.lit("_:"), F.hex("file"), F.lit("-"), c.substr(F.lit(3), F.length(c)))
    node = lambda c: F.when(c.startswith("<"), _unescaped(F.expr("substring({0}, 2, length({0}) - 2)".format("rs" if c is s else "ro")))).otherwise(label(c))
    s, o = F.col("rs"), F.col("ro")
    literal = o.startswith('"')
    suffix = F.regexp_extract(o, r'"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$', 0)
    body = o.substr(F.lit(2), F.length(o) - F.length(suffix) - 1)
    lang = F.regexp_extract(suffix, r'"@([A-Za-z0-9-]+)$', 1)
    typed = F.regexp_extract(suffix, r'"\^\^<([^>]*)>$', 1)
    return rows.select(
        node(s).alias("s"), "p",
        F.when(literal, F.lit("L")).when(o.startswith("<"), F.lit("I")).otherwise(F.lit("B")).alias("k"),
        F.when(literal, _unescaped(body)).otherwise(node(o)).alias("lex"),
        F.when(literal, F.when(lang != "", F.lit(LANG_STRING)).when(typed != "", typed).otherwise(F.lit(STRING))).alias("dt"),
        F.when(literal & (lang != ""), F.lower(lang)).alias("lang"),
    )


def _unescaped(c):
    """N-Triples escapes, decoded as those of JSON, which are the same but for \\U; only rows with a backslash are touched."""
    pieces = F.split(c, r"(?<=(?:^|[^\\])(?:\\\\){0,50})\\U(?=[0-9A-Fa-f]{8})")

    def short(x):
        code = F.conv(F.substring(x, 1, 8), 16, 10).cast("long") - 0x10000
        unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.hex(n), 4, "0"))
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(code, 10)), unit(F.lit(0xDC00) + code.bitwiseAND(0x3FF)))
        return F.concat(F.when(code < 0, F.concat(F.lit("\\u"), F.substring(x, 5, 4))).otherwise(pair), x.substr(F.lit(9), F.length(x)))

    plain = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), short), ""))
    options = {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"}
    decoded = F.get(F.from_json(F.concat(F.lit('["'), plain, F.lit('"]')), "array<string>", options), F.lit(0))
    return F.when(c.contains("\\"), F.coalesce(decoded, c)).otherwise(c)


class TurtleReader(P.TermReader):
    """A Turtle document to triples, on the driver: for mappings, ontologies and small data."""

    def __init__(self, text: str, base: str = "", scope: str = ""):
        super().__init__(P.Tokens(text), base)
        self.out: list[tuple[Term, Term, Term]] = []
        self.scope = scope

    def triples(self) -> list[tuple[Term, Term, Term]]:
        while True:
            self.prologue()
            if self.t.peek()[0] == "end":
                return self.out
            bracket = self.t.peek()[1] == "["
            s = self.node()
            if not (bracket and self.t.peek()[1] == "."):
                self.properties(s)
            self.t.need(".")

    def properties(self, s: Term) -> None:
        while True:
            if self.t.peek() == ("word", "a"):
                self.t.next()
                p = Iri(RDF_TYPE)
            else:
                p = self.iri()
            while True:
                self.out.append((s, p, self.node()))
                if not self.t.take(","):
                    break
            if not self.t.take(";"):
                return
            while self.t.take(";"):
                pass
            if self.t.peek()[1] in (".", "]", ""):
                return

    def node(self) -> Term:
        kind, text = self.t.peek()
        if kind == "blank":
            self.t.next()
            return Blank(self.scope + text[2:])
        if self.t.take("["):
            b = Blank(self.scope + self.fresh()[1:])
            if not self.t.take("]"):
                self.properties(b)
                self.t.need("]")
            return b
        if self.t.take("("):
            items = []
            while not self.t.take(")"):
                items.append(self.node())
            head: Term = Iri(RDF + "nil")
            for x in reversed(items):
                cell = Blank(self.scope + self.fresh()[1:])
                self.out += [(cell, Iri(RDF + "first"), x), (cell, Iri(RDF + "rest"), head)]
                head = cell
            return head
        return self.literal() or self.iri()


def rows_of(triples: list[tuple[Term, Term, Term]]) -> list[tuple]:
    def name(t: Term) -> str:
        return t.value if isinstance(t, Iri) else f"_:{t.label}"

    return [(name(s), p.value, *(("L", o.lex, o.dt, o.lang) if isinstance(o, Lit) else ("I" if isinstance(o, Iri) else "B", name(o), None, None))) for s, p, o in triples]


def from_turtle(spark: SparkSession, text: str, name: str = "turtle") -> TripleSource:
    return TripleSource(spark.createDataFrame(rows_of(TurtleReader(text, scope=f"{name}-").triples()), SCHEMA), name)


def read_text(spark: SparkSession, path: str) -> str:
    """A whole small file through Spark's readers."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def _turtle_rows(text: str, base: str, scope: str) -> list[tuple]:
    return rows_of(TurtleReader(text, base, scope).triples())


#: Parsers of whole documents by file name; all other files are N-Triples or N-Quads.
DOCUMENTS = {(".ttl", ".turtle", ".n3"): _turtle_rows, (".rdf", ".owl", ".xml"): rdf_xml, (".jsonld", ".json"): json_ld}


def rdf_file(spark: SparkSession, paths, name: str = "rdf", malformed: str = "raise") -> TripleSource:
    """RDF files as one graph, compressed (.gz) or not: lines of N-Triples and N-Quads are split over tasks; Turtle, RDF/XML and
    JSON-LD documents are read by one task each."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds = {p: next((k for k in DOCUMENTS if p.removesuffix(".gz").endswith(k)), None) for p in paths}
    lines = [p for p in paths if kinds[p] is None]
    parts = [read_ntriples(spark, lines, malformed)] if lines else []
    for kind, parse in DOCUMENTS.items():
        own = [p for p in paths if kinds[p] == kind]
        if own:
            files = spark.read.format("binaryFile").load(own).select("path", "content", F.hex(F.xxhash64("path")).alias("file"))
            parts.append(files.mapInPandas(parse_files(parse, "-"), SCHEMA))
    return TripleSource(reduce(lambda a, b: a.unionByName(b), parts).distinct(), name)


def parquet_store(spark: SparkSession, path: str, name: str = "store") -> TripleSource:
    """A triple table written by `save`, partitioned by predicate."""
    return TripleSource(spark.read.parquet(path).select(*[c.split()[0] for c in SCHEMA.split(", ")]), name)


def save(source: TripleSource, path: str, salts: int = 16) -> None:
    """Writes the triples as Parquet, one folder per predicate, so that patterns read only theirs.

    A predicate's triples are dealt over `salts` tasks by their subject: a frequent one isn't one task.
    """
    dealt = source.df.repartition(F.col("p"), F.pmod(F.xxhash64("s"), F.lit(salts)))
    dealt.write.partitionBy("p").parquet(path)
