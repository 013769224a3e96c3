"""FILTER and BIND expressions to columns: values keep native types; errors and unbound values are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.relation import Binding, as_term, constant, equal_terms, iri_text, lexical
from ..plans.algebra import Expr
from ..terms import BOOLEAN, DATE, DATETIME, DECIMAL, DOUBLE, FLOAT, INTEGER, INTEGERS, LANG_STRING, NUMERIC, RDF, STRING, XSD, Var

RANK = {INTEGER: 0, DECIMAL: 1, FLOAT: 2, DOUBLE: 3}
Names = dict[str, tuple[Column, Binding]]
BOOL, TEXT, INT = Binding("lit", dt=BOOLEAN), Binding("lit", dt=STRING), Binding("lit", dt=INTEGER)


class UnknownFunction(ValueError):
    pass


def numeric_type(dt: str | None) -> str | None:
    return INTEGER if dt in INTEGERS else dt if dt in NUMERIC else None


def evaluate(e, names: Names) -> tuple[Column, Binding]:
    """The value of an expression over the bound names; a variable that nothing binds is null."""
    if isinstance(e, Var):
        return names.get(e.name, (F.lit(None).cast("string"), Binding("lit", dt=STRING, nullable=True)))
    if not isinstance(e, Expr):
        return constant(e)
    if e.name in SPECIAL:
        return SPECIAL[e.name](e, names)
    args = [evaluate(a, names) for a in e.args]
    if e.name in FUNCTIONS:
        return FUNCTIONS[e.name](*args)
    if e.name.startswith(XSD):
        return cast(args[0], e.name)
    raise UnknownFunction(e.name)


def condition(e, names: Names) -> Column:
    return truth(evaluate(e, names))


def truth(v) -> Column:
    """Effective boolean value."""
    c, b = v
    if b.kind == "iri":
        return F.lit(None).cast("boolean")
    if b.kind == "term":
        number = c["lex"].try_cast("double")
        return F.when(c["dt"] == BOOLEAN, c["lex"].isin("true", "1")).when(c["dt"].isin(*sorted(NUMERIC)), number != 0).when(c["dt"].isin(STRING, LANG_STRING), c["lex"] != "")
    if b.dt == BOOLEAN:
        return c.cast("boolean")
    if numeric_type(b.dt):
        return (c != 0) & ~F.isnan(c.cast("double"))
    return c != "" if b.dt in (STRING, LANG_STRING) else F.lit(None).cast("boolean")


def number(v) -> tuple[Column, str | None]:
    """The numeric value (null if it has none) and its type; mixed terms count as doubles."""
    c, b = v
    if b.kind == "term":
        return F.when(c["dt"].isin(*sorted(NUMERIC)), c["lex"].try_cast("double")), DOUBLE
    t = numeric_type(b.dt) if b.kind == "lit" else None
    return (c, t) if t else (F.lit(None).cast("double"), None)


def text(v) -> Column:
    """The text of a string-like literal (null for others)."""
    c, b = v
    if b.kind == "term":
        return F.when(c["dt"].isin(STRING, LANG_STRING), c["lex"])
    return c.cast("string") if b.kind == "lit" and b.dt in (STRING, LANG_STRING) else F.lit(None).cast("string")


def str_of(v) -> Column:
    c, b = v
    return c["lex"] if b.kind == "term" else iri_text(c, b) if b.kind == "iri" else lexical(c, b.dt)


def time_of(v) -> Column:
    c, b = v
    if b.kind == "term":
        return F.when(c["dt"].isin(DATETIME, DATE), c["lex"].try_cast("timestamp"))
    return c.cast("timestamp") if b.kind == "lit" and b.dt in (DATETIME, DATE) else F.lit(None).cast("timestamp")


def compare(op: str, x, y) -> Column:
    """Value comparison; operands without a common value space: equality by term, order is an error."""
    (a, p), (b, q) = x, y
    order = {"=": lambda m, n: m == n, "!=": lambda m, n: m != n, "<": lambda m, n: m < n, "<=": lambda m, n: m <= n, ">": lambda m, n: m > n, ">=": lambda m, n: m >= n}[op]
    if p.kind != "term" and q.kind != "term":
        if p.kind == q.kind == "lit":
            if numeric_type(p.dt) and numeric_type(q.dt):
                return order(a, b)
            if p.dt in (DATETIME, DATE) and q.dt in (DATETIME, DATE):
                return order(a, b) if p.dt == q.dt else order(time_of(x), time_of(y))
            if p.dt == q.dt == BOOLEAN or (p.dt == q.dt == STRING):
                return order(a, b)
        eq = equal_terms(a, p, b, q)
        if op in ("=", "!="):
            eq = F.lit(False) if eq is None else eq
            both = F.when(a.isNotNull() & b.isNotNull(), eq if op == "=" else ~eq)
            return both
        return F.lit(None).cast("boolean")
    m, n = number(x)[0], number(y)[0]
    s, t = text(x), text(y)
    u, w = time_of(x), time_of(y)
    by_value = F.when(m.isNotNull() & n.isNotNull(), order(m, n))
    if op in ("=", "!="):
        eq = equal_terms(a, p, b, q)
        return F.coalesce(by_value, F.when(u.isNotNull() & w.isNotNull(), order(u, w)), F.when(a.isNotNull() & b.isNotNull(), eq if op == "=" else ~eq))
    return F.coalesce(by_value, F.when(s.isNotNull() & t.isNotNull(), order(s, t)), F.when(u.isNotNull() & w.isNotNull(), order(u, w)))


def ordered(x, y) -> tuple[Column, Column] | None:
    """Doubles that are in the order of the values (equal for some that differ little); None where the types say nothing of it."""
    (_, p), (_, q) = x, y
    if p.kind == q.kind == "lit":
        if numeric_type(p.dt) and numeric_type(q.dt):
            return number(x)[0].cast("double"), number(y)[0].cast("double")
        if p.dt in (DATETIME, DATE) and q.dt in (DATETIME, DATE):
            return F.unix_micros(time_of(x)).cast("double"), F.unix_micros(time_of(y)).cast("double")
    return None


def arithmetic(op: str, x, y) -> tuple[Column, Binding]:
    (a, p), (b, q) = number(x), number(y)
    out = max((t for t in (p, q) if t), key=RANK.get, default=DOUBLE)
    if op == "/":
        if out == INTEGER:
            a, b, out = a.cast("decimal(38,10)"), b.cast("decimal(38,10)"), DECIMAL
        return F.try_divide(a, b), Binding("lit", dt=out)
    if out == INTEGER:
        a, b = a.cast("long"), b.cast("long")
    return {"+": a + b, "-": a - b, "*": a * b}[op], Binding("lit", dt=out)


def cast(v, dt: str) -> tuple[Column, Binding]:
    c, b = v
    native = {BOOLEAN: "boolean", DECIMAL: "decimal(38,10)", DOUBLE: "double", FLOAT: "double", DATE: "date", DATETIME: "timestamp"}
    if dt == STRING:
        return str_of(v), TEXT
    kind = "bigint" if dt in INTEGERS else native.get(dt)
    if kind is None:
        return str_of(v), Binding("lit", dt=dt)
    source = c if b.kind == "lit" and b.dt not in (STRING, LANG_STRING) else F.trim(str_of(v))
    return source.try_cast(kind), Binding("lit", dt=dt)


def _mixed(values: list) -> tuple[list[Column], Binding]:
    """Alternatives as columns of one shape."""
    shapes = [b for _, b in values]
    if all(shapes[0].same_shape(b) for b in shapes):
        return [c for c, _ in values], shapes[0]
    if all(b.kind == "lit" and numeric_type(b.dt) for b in shapes):
        top = max((numeric_type(b.dt) for b in shapes), key=RANK.get)
        return [c for c, _ in values], Binding("lit", dt=top)
    return [as_term(c, b) for c, b in values], Binding("term")


def _if(e: Expr, names: Names):
    test = condition(e.args[0], names)
    (a, b), shape = _mixed([evaluate(x, names) for x in e.args[1:]])
    return F.when(test, a).when(~test, b), shape


def _coalesce(e: Expr, names: Names):
    cols, shape = _mixed([evaluate(x, names) for x in e.args])
    return F.coalesce(*cols), shape


def _bound(e: Expr, names: Names):
    v = names.get(e.args[0].name)
    return (v[0].isNotNull() if v else F.lit(False)), BOOL


def _in(e: Expr, names: Names):
    x = evaluate(e.args[0], names)
    hits = [compare("=", x, evaluate(a, names)) for a in e.args[1:]]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out, BOOL


SPECIAL = {
    "if": _if,
    "coalesce": _coalesce,
    "bound": _bound,
    "in": _in,
    "&&": lambda e, n: (condition(e.args[0], n) & condition(e.args[1], n), BOOL),
    "||": lambda e, n: (condition(e.args[0], n) | condition(e.args[1], n), BOOL),
    "!": lambda e, n: (~condition(e.args[0], n), BOOL),
    "now": lambda e, n: (F.current_timestamp(), Binding("lit", dt=DATETIME)),
    "rand": lambda e, n: (F.rand(), Binding("lit", dt=DOUBLE)),
    "uuid": lambda e, n: (F.concat(F.lit("urn:uuid:"), F.uuid()), Binding("iri")),
    "struuid": lambda e, n: (F.uuid(), TEXT),
    "bnode": lambda e, n: (F.concat(F.lit("_:"), F.uuid() if not e.args else str_of(evaluate(e.args[0], n))), Binding("iri")),
}


def _kind_is(v, kind: str) -> Column:
    c, b = v
    if b.kind == "term":
        return c["k"] == kind
    if b.kind == "iri":
        blank = iri_text(c, b).startswith("_:")
        return F.when(c.isNotNull(), blank if kind == "B" else ~blank if kind == "I" else F.lit(False))
    return F.when(c.isNotNull(), F.lit(kind == "L"))


def _is_numeric(v) -> Column:
    c, b = v
    if b.kind == "term":
        return F.coalesce(c["dt"].isin(*sorted(NUMERIC)), F.when(c.isNotNull(), F.lit(False)))
    return F.when(c.isNotNull(), F.lit(b.kind == "lit" and numeric_type(b.dt) is not None))


def _lang(v) -> Column:
    c, b = v
    if b.kind == "term":
        return F.when(c["k"] == "L", F.coalesce(c["lang"], F.lit("")))
    return F.when(c.isNotNull(), F.lit(b.lang or "")) if b.kind == "lit" else F.lit(None).cast("string")


def _datatype(v) -> Column:
    c, b = v
    return c["dt"] if b.kind == "term" else F.when(c.isNotNull(), F.lit(b.dt)) if b.kind == "lit" else F.lit(None).cast("string")


def _regex(x, p, flags=None):
    pattern = text(p)
    if flags is not None:
        f = text(flags)
        pattern = F.concat(F.when(f == "", F.lit("")).otherwise(F.concat(F.lit("(?"), f, F.lit(")"))), pattern)
    return F.rlike(text(x), pattern), BOOL


def _replace(x, p, r, flags=None):
    pattern = text(p) if flags is None else F.concat(F.lit("(?"), text(flags), F.lit(")"), text(p))
    return F.regexp_replace(text(x), pattern, text(r)), _like(x)


def _like(v) -> Binding:
    """A string result keeps the language of its first argument."""
    return Binding("lit", dt=v[1].dt, lang=v[1].lang) if v[1].kind == "lit" and v[1].dt == LANG_STRING else TEXT


def _substr(x, start, length=None):
    s, at = text(x), number(start)[0].cast("int")
    return (F.substr(s, at) if length is None else F.substr(s, at, number(length)[0].cast("int"))), _like(x)


def _around(x, y, before: bool):
    s, m = text(x), text(y)
    place = F.instr(s, m)
    cut = F.substr(s, F.lit(1), place - 1) if before else F.substr(s, place + F.length(m))
    return F.when(place > 0, cut).otherwise(F.lit("")), _like(x)


def _lang_matches(x, y):
    tag, wanted = F.lower(text(x)), F.lower(text(y))
    return F.when(wanted == "*", tag != "").otherwise((tag == wanted) | F.startswith(tag, F.concat(wanted, F.lit("-")))), BOOL


def _rounded(f, v):
    c, t = number(v)
    return (c if t == INTEGER else f(c)), Binding("lit", dt=t or DOUBLE)


def _round(c: Column) -> Column:
    return F.floor(c + 0.5).cast("double")


def _part(f):
    return lambda v: (f(time_of(v)), INT)


def _zone(v, as_duration: bool):
    z = F.regexp_extract(str_of(v), r"(Z|[+-][0-9]{2}:[0-9]{2})$", 1)
    if not as_duration:
        return z, TEXT
    sign, hours, minutes = F.when(z.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    some = F.concat(sign, F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(F.lit("")), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(F.lit("")))
    return F.when(z == "", F.lit(None)).when((z == "Z") | ((hours == 0) & (minutes == 0)), F.lit("PT0S")).otherwise(some), Binding("lit", dt=XSD + "dayTimeDuration")


def _hash(f):
    return lambda v: (f(F.encode(text(v), "UTF-8")), TEXT)


FUNCTIONS = {
    **{op: (lambda o: lambda x, y: (compare(o, x, y), BOOL))(op) for op in ("=", "!=", "<", "<=", ">", ">=")},
    **{op: (lambda o: lambda x, y: arithmetic(o, x, y))(op) for op in "+-*/"},
    "neg": lambda v: (-number(v)[0], Binding("lit", dt=number(v)[1] or DOUBLE)),
    "pos": lambda v: (number(v)[0], Binding("lit", dt=number(v)[1] or DOUBLE)),
    "sameterm": lambda x, y: (F.lit(False) if (eq := equal_terms(x[0], x[1], y[0], y[1])) is None else eq, BOOL),
    "isiri": lambda v: (_kind_is(v, "I"), BOOL),
    "isuri": lambda v: (_kind_is(v, "I"), BOOL),
    "isblank": lambda v: (_kind_is(v, "B"), BOOL),
    "isliteral": lambda v: (_kind_is(v, "L"), BOOL),
    "isnumeric": lambda v: (_is_numeric(v), BOOL),
    "str": lambda v: (str_of(v), TEXT),
    "lang": lambda v: (_lang(v), TEXT),
    "datatype": lambda v: (_datatype(v), Binding("iri")),
    "iri": lambda v: (str_of(v), Binding("iri")),
    "uri": lambda v: (str_of(v), Binding("iri")),
    "strdt": lambda v, d: (as_term_of(text(v), str_of(d)), Binding("term")),
    "strlang": lambda v, t: (F.struct(F.lit("L").alias("k"), text(v).alias("lex"), F.lit(LANG_STRING).alias("dt"), F.lower(text(t)).alias("lang")), Binding("term")),
    "strlen": lambda v: (F.length(text(v)), INT),
    "substr": _substr,
    "ucase": lambda v: (F.upper(text(v)), _like(v)),
    "lcase": lambda v: (F.lower(text(v)), _like(v)),
    "strstarts": lambda x, y: (F.startswith(text(x), text(y)), BOOL),
    "strends": lambda x, y: (F.endswith(text(x), text(y)), BOOL),
    "contains": lambda x, y: (F.contains(text(x), text(y)), BOOL),
    "strbefore": lambda x, y: _around(x, y, True),
    "strafter": lambda x, y: _around(x, y, False),
    "concat": lambda *v: (F.concat(*[text(x) for x in v]), TEXT),
    "encode_for_uri": lambda v: (F.replace(F.replace(F.replace(F.url_encode(text(v)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), TEXT),
    "langmatches": _lang_matches,
    "regex": _regex,
    "replace": _replace,
    "abs": lambda v: _rounded(F.abs, v) if number(v)[1] != INTEGER else (F.abs(v[0]), INT),
    "ceil": lambda v: _rounded(lambda c: F.ceil(c).cast("double"), v),
    "floor": lambda v: _rounded(lambda c: F.floor(c).cast("double"), v),
    "round": lambda v: _rounded(_round, v),
    "year": _part(F.year),
    "month": _part(F.month),
    "day": _part(F.dayofmonth),
    "hours": _part(F.hour),
    "minutes": _part(F.minute),
    "seconds": _part(F.second),
    "timezone": lambda v: _zone(v, True),
    "tz": lambda v: _zone(v, False),
    "md5": _hash(F.md5),
    "sha1": _hash(F.sha1),
    **{f"sha{n}": _hash((lambda k: lambda c: F.sha2(c, k))(n)) for n in (256, 384, 512)},
}


def as_term_of(lex: Column, dt: Column) -> Column:
    return F.when(lex.isNotNull(), F.struct(F.lit("L").alias("k"), lex.alias("lex"), dt.alias("dt"), F.lit(None).cast("string").alias("lang")))
