"""Relations: DataFrames whose columns are query variables, with what is known of each variable's terms.

A variable's column stays native (a key, a number, a timestamp) as long as all its terms have one shape; what is
constant (IRI prefix, datatype, language) lives in the Binding. Only where shapes meet does a column become a struct.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..terms import BOOLEAN, DATE, DATETIME, DECIMAL, DOUBLE, FLOAT, INTEGER, INTEGERS, LANG_STRING, STRING, Blank, Iri, Lit

TERM = "struct<k:string,lex:string,dt:string,lang:string>"


@dataclass(frozen=True)
class Binding:
    """kind: iri (prefix + column), lit (column of one datatype and language), term (a TERM struct)."""

    kind: str
    prefix: str = ""
    dt: str | None = None
    lang: str | None = None
    nullable: bool = False

    def maybe(self) -> Binding:
        return replace(self, nullable=True)

    def same_shape(self, other: Binding) -> bool:
        return (self.kind, self.prefix, self.dt, self.lang) == (other.kind, other.prefix, other.dt, other.lang)


TERMS = Binding("term")


@dataclass
class Relation:
    """keys: variables of which no two rows have the same term, as far as known."""

    df: DataFrame
    vars: dict[str, Binding]
    keys: frozenset[str] = frozenset()

    def col(self, v: str) -> Column:
        return F.col(f"`{v}`")

    @property
    def spark(self):
        return self.df.sparkSession


#: Spark type names by the datatype that their values have as literals.
NATURAL = {"tinyint": INTEGER, "smallint": INTEGER, "int": INTEGER, "bigint": INTEGER, "float": DOUBLE, "double": DOUBLE, "boolean": BOOLEAN, "date": DATE, "timestamp": DATETIME, "timestamp_ntz": DATETIME, "string": STRING}


def natural_datatype(spark_type: str) -> str:
    return DECIMAL if spark_type.startswith("decimal") else NATURAL.get(spark_type, STRING)


def lexical(c: Column, dt: str | None) -> Column:
    """The lexical form of a native value."""
    if dt == DATETIME:
        text = F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    if dt in (DOUBLE, FLOAT):
        text = F.format_string("%.15E", c.cast("double"))
        plain = F.regexp_replace(F.regexp_replace(text, r"0+E", "E"), r"\.E", ".0E")
        return F.regexp_replace(F.regexp_replace(plain, r"E\+?(-?)0*([0-9])", "E$1$2"), "E-0$", "E0")
    return c.cast("string")


def iri_text(c: Column, b: Binding) -> Column:
    return F.concat(F.lit(b.prefix), c.cast("string")) if b.prefix else c.cast("string")


def as_term(c: Column, b: Binding) -> Column:
    """The TERM struct of a binding's column; null stays null."""
    if b.kind == "term":
        return c
    if b.kind == "iri":
        text = iri_text(c, b)
        kind = F.when(text.startswith("_:"), F.lit("B")).otherwise(F.lit("I")) if not b.prefix else F.lit("B" if b.prefix.startswith("_:") else "I")
        made = F.struct(kind.alias("k"), text.alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
    else:
        made = F.struct(F.lit("L").alias("k"), lexical(c, b.dt).alias("lex"), F.lit(b.dt).alias("dt"), F.lit(b.lang).cast("string").alias("lang"))
    return F.when(c.isNotNull(), made)


def constant(t) -> tuple[Column, Binding]:
    """A ground term as a native column."""
    if isinstance(t, Iri):
        return F.lit(t.value), Binding("iri")
    if isinstance(t, Blank):
        return F.lit(f"_:{t.label}"), Binding("iri")
    if t.dt in INTEGERS and t.lex.lstrip("+-").isdigit():
        return F.lit(int(t.lex)), Binding("lit", dt=t.dt)
    if t.dt == DECIMAL:
        return F.lit(t.lex).cast("decimal(38,10)"), Binding("lit", dt=t.dt)
    if t.dt in (DOUBLE, FLOAT):
        return F.lit(float(t.lex)), Binding("lit", dt=t.dt)
    if t.dt == BOOLEAN:
        return F.lit(t.lex in ("true", "1")), Binding("lit", dt=t.dt)
    if t.dt == DATETIME:
        return F.lit(t.lex).cast("timestamp"), Binding("lit", dt=t.dt)
    if t.dt == DATE:
        return F.lit(t.lex).cast("date"), Binding("lit", dt=t.dt)
    return F.lit(t.lex), Binding("lit", dt=t.dt, lang=t.lang)


def term_of(t) -> Column:
    """A ground term as a TERM struct, in its own lexical form."""
    kind = "I" if isinstance(t, Iri) else "B" if isinstance(t, Blank) else "L"
    lex = t.value if kind == "I" else f"_:{t.label}" if kind == "B" else t.lex
    return F.struct(F.lit(kind).alias("k"), F.lit(lex).alias("lex"), F.lit(t.dt if kind == "L" else None).cast("string").alias("dt"), F.lit(t.lang if kind == "L" else None).cast("string").alias("lang"))


def term_key(t: Column) -> Column:
    """A TERM struct as one text, equal for equal terms; term_of_key is its inverse."""
    return F.concat_ws("\x1f", t["k"], F.coalesce(t["dt"], F.lit("")), F.coalesce(t["lang"], F.lit("")), t["lex"])


def term_of_key(c: Column) -> Column:
    part = F.split(c, "\x1f", 4)
    none = lambda x: F.nullif(x, F.lit(""))
    return F.struct(part[0].alias("k"), part[3].alias("lex"), none(part[1]).alias("dt"), none(part[2]).alias("lang"))


def equal_terms(a: Column, x: Binding, b: Column, y: Binding) -> Column | None:
    """Term equality of two bindings; None if no two of their terms can be equal."""
    if x.kind == "term" or y.kind == "term":
        p, q = as_term(a, x), as_term(b, y)
        return (p["k"] == q["k"]) & (p["lex"] == q["lex"]) & p["dt"].eqNullSafe(q["dt"]) & p["lang"].eqNullSafe(q["lang"])
    if x.kind != y.kind:
        return None
    if x.kind == "iri":
        if x.prefix == y.prefix:
            return a == b
        if not (x.prefix.startswith(y.prefix) or y.prefix.startswith(x.prefix)):
            return None
        if x.prefix and not y.prefix:  # a constant or free IRI against a key: compare keys, so that scans can filter
            key = F.when(b.startswith(x.prefix), b.substr(F.lit(len(x.prefix) + 1), F.length(b)))
            return a.cast("string") == key
        if y.prefix and not x.prefix:
            return equal_terms(b, y, a, x)
        return iri_text(a, x) == iri_text(b, y)
    return a == b if (x.dt, x.lang) == (y.dt, y.lang) else None


def aligned(rels: list[Relation]) -> list[Relation]:
    """The same variables in all relations, each of one shape: native where all agree, else TERM structs."""
    names = list(dict.fromkeys(v for r in rels for v in r.vars))
    shape: dict[str, Binding] = {}
    for v in names:
        held = [r.vars[v] for r in rels if v in r.vars]
        nullable = len(held) < len(rels) or any(b.nullable for b in held)
        one = held[0] if all(held[0].same_shape(b) for b in held) else Binding("iri") if all(b.kind == "iri" for b in held) else TERMS
        shape[v] = replace(one, nullable=nullable)
    out = []
    for r in rels:
        cols = []
        for v in names:
            if v not in r.vars:
                cols.append(F.lit(None).cast(TERM if shape[v].kind == "term" else "string" if shape[v].kind == "iri" and not shape[v].prefix else _type_of(rels, v)).alias(v))
            elif r.vars[v].same_shape(shape[v]):
                cols.append(r.col(v).alias(v))
            else:
                cols.append((iri_text(r.col(v), r.vars[v]) if shape[v].kind == "iri" else as_term(r.col(v), r.vars[v])).alias(v))
        out.append(Relation(r.df.select(*cols), dict(shape)))
    return out


def _type_of(rels: list[Relation], v: str) -> str:
    return next(dict(r.df.dtypes)[v] for r in rels if v in r.vars)


def union(rels: list[Relation]) -> Relation:
    if len(rels) == 1:
        return rels[0]
    rels = aligned(rels)
    return Relation(reduce(lambda a, b: a.unionByName(b), (r.df for r in rels)), rels[0].vars)


def _sides(left: Relation, right: Relation) -> tuple[DataFrame, DataFrame]:
    """Both with columns of their own: the right one's are prefixed."""
    return left.df, right.df.select(*[right.col(v).alias(f"..{v}") for v in right.vars])


def _condition(left: Relation, right: Relation) -> tuple[Column | None, bool]:
    """Compatibility of the shared variables; whether it can hold at all."""
    cond = None
    for v in left.vars:
        if v not in right.vars:
            continue
        a, b, x, y = F.col(f"`{v}`"), F.col(f"`..{v}`"), left.vars[v], right.vars[v]
        eq = equal_terms(a, x, b, y)
        if eq is None and not (x.nullable or y.nullable):
            return None, False
        eq = F.lit(False) if eq is None else eq
        if x.nullable:
            eq = eq | a.isNull()
        if y.nullable:
            eq = eq | b.isNull()
        cond = eq if cond is None else cond & eq
    return cond, True


def _merged(joined: DataFrame, left: Relation, right: Relation, outer: bool) -> Relation:
    cols, vars_ = [], {}
    for v, x in left.vars.items():
        c, b = F.col(f"`{v}`"), x
        if v in right.vars and x.nullable:
            y = right.vars[v]
            if x.same_shape(y):
                c = F.coalesce(c, F.col(f"`..{v}`"))
            else:
                c, b = F.coalesce(as_term(c, x), as_term(F.col(f"`..{v}`"), y)), TERMS
            b = replace(b, nullable=outer or y.nullable)
        cols.append(c.alias(v))
        vars_[v] = b
    for v, y in right.vars.items():
        if v not in left.vars:
            cols.append(F.col(f"`..{v}`").alias(v))
            vars_[v] = y.maybe() if outer else y
    return Relation(joined.select(*cols), vars_)


#: Shared variables that may be unbound up to which a join is split by which of them are.
MOST_PATTERNS = 3


def _strict(left: Relation, right: Relation) -> bool:
    """Whether some shared variable is always bound: it is the join's key, whatever the others allow."""
    return any(v in right.vars and not left.vars[v].nullable and not right.vars[v].nullable for v in left.vars)


def _patterns(r: Relation, other: Relation) -> list[tuple[Relation, frozenset[str]]]:
    """The relation's rows by which of the variables that it shares with the other are unbound: (rows, unbound ones).

    In each part the other variables count as bound, and the unbound ones as absent.
    """
    open_ = [v for v in r.vars if v in other.vars and r.vars[v].nullable]
    out = []
    for bits in range(1 << len(open_)):
        unbound = frozenset(v for i, v in enumerate(open_) if bits >> i & 1)
        tests = [r.col(v).isNull() if v in unbound else r.col(v).isNotNull() for v in open_]
        df = r.df.where(reduce(lambda a, b: a & b, tests)) if tests else r.df
        out.append((Relation(df, {v: replace(b, nullable=False) if v in open_ else b for v, b in r.vars.items()}), unbound))
    return out


def _split(left: Relation, right: Relation) -> bool:
    """Whether unbound variables would leave the join without a key, and few enough of them are shared to split it."""
    shared = [v for v in left.vars if v in right.vars]
    return bool(shared) and not _strict(left, right) and sum(r.vars[v].nullable for r in (left, right) for v in shared) <= MOST_PATTERNS


def _without(r: Relation, names: frozenset[str]) -> Relation:
    return Relation(r.df, {v: b for v, b in r.vars.items() if v not in names})


def join(left: Relation, right: Relation) -> Relation:
    """Natural join by term equality; unbound variables are compatible with anything.

    If every shared variable may be unbound, rows are split by which of them are, so that each part is an equality join
    on the others; only rows that share no bound variable at all form a product.
    """
    if not _split(left, right):
        out, strict = _joined(left, right), [v for v in left.vars if v in right.vars and not left.vars[v].nullable and not right.vars[v].nullable]
        kept = [a.keys for a, b in ((left, right), (right, left)) if b.keys.intersection(strict)]  # each row meets one at most
        return replace(out, keys=frozenset().union(*kept))
    parts = []
    for a, p in _patterns(left, right):
        for b, q in _patterns(right, left):
            own, others = _sides(a, b)
            cond, possible = _condition(_without(a, q), _without(b, p))
            if possible:
                parts.append(own.crossJoin(others) if cond is None else own.join(others, cond))
    if not parts:
        own, others = _sides(left, right)
        parts = [own.crossJoin(others).where(F.lit(False))]
    return _merged(reduce(lambda a, b: a.unionByName(b), parts), left, right, False)


def _joined(left: Relation, right: Relation) -> Relation:
    a, b = _sides(left, right)
    cond, possible = _condition(left, right)
    if not possible:
        return _merged(a.crossJoin(b).where(F.lit(False)), left, right, False)
    return _merged(a.crossJoin(b) if cond is None else a.join(b, cond), left, right, False)


def left_join(left: Relation, right: Relation, condition=None) -> Relation:
    """OPTIONAL. condition: from the joined relation to a Column, or None.

    Split as join is where only the left side's variables may be unbound.
    """
    if _split(left, right) and not any(right.vars[v].nullable for v in left.vars if v in right.vars):
        parts = [_left_joined(a, _without(right, p), condition, right) for a, p in _patterns(left, right)]
        return _merged(reduce(lambda a, b: a.unionByName(b), parts), left, right, True)
    return _merged(_left_joined(left, right, condition, right), left, right, True)


def _left_joined(left: Relation, keyed: Relation, condition, right: Relation) -> DataFrame:
    """keyed: the right relation with the variables that count for compatibility."""
    a, b = _sides(left, right)  # all of the right side's columns
    cond, possible = _condition(left, keyed)
    cond = F.lit(False) if not possible else F.lit(True) if cond is None else cond
    if condition is not None:
        names = {**{v: (F.col(f"`..{v}`"), y) for v, y in right.vars.items()}, **{v: (F.col(f"`{v}`"), x) for v, x in left.vars.items() if v in keyed.vars or v not in right.vars}}
        cond = cond & F.coalesce(condition(names), F.lit(False))
    return a.join(b, cond, "left")


def semi_join(left: Relation, right: Relation, anti: bool, need_shared: bool) -> Relation:
    """[NOT] EXISTS (need_shared False) and MINUS (True: rows that share no bound variable stay). Split as join is."""
    shared = [v for v in left.vars if v in right.vars]
    if not shared and need_shared:
        return left
    if not _split(left, right):
        return _semi_joined(left, right, anti, need_shared)
    kept = []
    for a, p in _patterns(left, right):
        rest = a
        for b, q in _patterns(right, left):
            if need_shared and not set(shared) - p - q:
                continue
            x, y = _without(rest, q), _without(b, p)
            if not anti:
                kept.append(_semi_joined(x, y, False, False).df)
            rest = Relation(_semi_joined(x, y, True, False).df, rest.vars)
        if anti:
            kept.append(rest.df)
    return Relation(reduce(lambda a, b: a.unionByName(b), kept) if kept else left.df.where(F.lit(False)), left.vars)


def _semi_joined(left: Relation, right: Relation, anti: bool, need_shared: bool) -> Relation:
    shared = [v for v in left.vars if v in right.vars]
    cond, possible = _condition(left, right)
    a, b = _sides(left, right)
    if not possible:
        return left if anti else Relation(left.df.where(F.lit(False)), left.vars)
    if need_shared and any(left.vars[v].nullable or right.vars[v].nullable for v in shared):
        both = reduce(lambda x, y: x | y, [F.col(f"`{v}`").isNotNull() & F.col(f"`..{v}`").isNotNull() for v in shared])
        cond = cond & both
    return Relation(a.join(b, F.lit(True) if cond is None else cond, "left_anti" if anti else "left_semi"), left.vars)


def project(r: Relation, names: list[str]) -> Relation:
    """The named variables; those that nothing binds are null."""
    cols = [(r.col(v) if v in r.vars else F.lit(None).cast("string")).alias(v) for v in names]
    return Relation(r.df.select(*cols), {v: r.vars.get(v, Binding("iri", nullable=True)) for v in names})


def distinct(r: Relation) -> Relation:
    return Relation(r.df.distinct(), r.vars)


def values(spark, names: list[str], rows: list[list]) -> Relation:
    """A constant relation; None is unbound. Small by nature: it is written in the query."""
    if not rows:
        return Relation(spark.createDataFrame([], ", ".join(f"`{v}` string" for v in names)), {v: Binding("iri") for v in names})
    made = []
    for row in rows:
        bound = [(v, *constant(t)) for v, t in zip(names, row) if t is not None]
        made.append(Relation(spark.range(1).select(*[c.alias(v) for v, c, _ in bound]), {v: b for v, _, b in bound}))
    out = union(made)
    return Relation(out.df, {v: out.vars[v] for v in names if v in out.vars})


def render(r: Relation, how: str = "native") -> DataFrame:
    """native: IRIs as text, literals as values, mixed terms as their lexical form. terms: TERM structs. ntriples: text."""
    cols = []
    for v, b in r.vars.items():
        c = r.col(v)
        if how == "native":
            c = iri_text(c, b) if b.kind == "iri" else c["lex"] if b.kind == "term" else c
        else:
            c = as_term(c, b)
            if how == "ntriples":
                c = ntriples_text(c)
        cols.append(c.alias(v))
    return r.df.select(*cols)


def ntriples_text(t: Column) -> Column:
    lex = t["lex"]
    for raw, esc in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        lex = F.replace(lex, F.lit(raw), F.lit(esc))
    suffix = F.when(t["lang"].isNotNull(), F.concat(F.lit("@"), t["lang"])).when(t["dt"] == STRING, F.lit("")).otherwise(F.concat(F.lit("^^<"), t["dt"], F.lit(">")))
    return F.when(t["k"] == "I", F.concat(F.lit("<"), t["lex"], F.lit(">"))).when(t["k"] == "B", t["lex"]).otherwise(F.concat(F.lit('"'), lex, F.lit('"'), suffix))
