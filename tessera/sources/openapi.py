"""Web API descriptions (Swagger 2 as a dictionary, with the x- extensions for paths, paging and serialisation) to sources."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import SparkSession

from .webapi import Api, WebApiSource, fetch

#: Letters of Java's SimpleDateFormat by the directive of strftime.
DATE_LETTERS = {"yyyy": "%Y", "yy": "%y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S"}
TYPES = {"integer": "bigint", "number": "double", "boolean": "boolean", "string": "string"}


def date_format(pattern: str) -> str:
    return re.sub("|".join(DATE_LETTERS), lambda m: DATE_LETTERS[m[0]], pattern)


def serializer(spec: dict) -> Callable[[str], str]:
    """How a parameter's value is written: `date` by a format, `only-numbers` with an optional width and fill."""
    if spec.get("serializer") == "date":
        pattern = date_format(spec["date-format"])
        return lambda v: datetime.fromisoformat(v).strftime(pattern)
    if spec.get("serializer") == "only-numbers":
        width, fill = int(spec.get("width", 0)), spec.get("fill", "0")
        return lambda v: re.sub("[^0-9]", "", v).rjust(width, fill)
    raise ValueError(f"unknown serializer {spec.get('serializer')!r}")


def resolved(node, root: dict):
    """Follows local `$ref`s, once per node on a path."""
    while isinstance(node, dict) and "$ref" in node:
        target = root
        for key in node["$ref"].removeprefix("#/").split("/"):
            target = target[key.replace("~1", "/").replace("~0", "~")]
        node = target
    return node


def columns(schema: dict, root: dict, prefix: str = "", depth: int = 6) -> dict[str, str]:
    """Primitive members of a response by their path (`a.b`), with Spark types."""
    schema = resolved(schema, root)
    out: dict[str, str] = {}
    for name, member in schema.get("properties", {}).items():
        member = resolved(member, root)
        if member.get("type") == "object" and depth:
            out |= columns(member, root, f"{prefix}{name}.", depth - 1)
        elif member.get("type", "string") in TYPES:
            out[prefix + name] = TYPES[member.get("type", "string")]
    return out


def comparison(text: str) -> str:
    """The operator of a parameter's filter over a member, `$actual >= $input` or the other way round."""
    m = re.fullmatch(r"\s*(?:FILTER)?\s*\(?\s*[$?](actual|input)\s*(<=|>=|<|>|=)\s*[$?](actual|input)\s*\)?\s*", text)
    if not m or m[1] == m[3]:
        raise ValueError(f"not a comparison of $actual with $input: {text!r}")
    return m[2] if m[1] == "actual" else {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "="}[m[2]]


def operation(spec: dict, path: str, vocabulary: str, get: Callable[[str], str] = fetch, interval: float = 0.0) -> Api:
    """The GET operation of a path. Members and inputs are named in the vocabulary by their path (`a.b`)."""
    get_op = resolved(spec["paths"][path], spec)["get"]
    paging = get_op.get("x-paging") or resolved(spec.get("x-paging", {}), spec).get("standard") or (spec.get("x-paging") if "param" in spec.get("x-paging", {}) else None)
    params = [resolved(p, spec) for p in get_op.get("parameters", [])]
    names = [p["name"] for p in params]
    page = paging["param"] if paging and paging["param"] in names else None
    inputs, writers, filters, needed = {}, {}, {}, set()
    for p in params:
        if "x-path" in p:
            predicate = vocabulary + ".".join(p["x-path"]["path"])
            if "filter" in p["x-path"]:
                filters[p["name"]] = (predicate, comparison(p["x-path"]["filter"]))
                needed |= {p["name"]} if p.get("required") else set()
            else:
                inputs[predicate] = p["name"]
            if "x-serializer" in p:
                writers[p["name"]] = serializer(resolved(p["x-serializer"], spec))
        elif p.get("required") and p["name"] != page:
            raise ValueError(f"{path}: the required parameter {p['name']} has no x-path")
    query = [n for n in names if f"{{{n}}}" not in path and (n in inputs.values() or n in filters or n == page)]
    base = f"{(spec.get('schemes') or ['http'])[0]}://{spec['host']}{spec.get('basePath', '').rstrip('/')}"
    schema = resolved(next(r for c, r in get_op["responses"].items() if str(c).startswith("2")).get("schema", {}), spec)
    if schema.get("type") == "array":
        schema = schema["items"]
    return Api(base + path + (f"{{?{','.join(query)}}}" if query else ""), inputs, columns(schema, spec), page=page, first_page=int((paging or {}).get("start", 1)), page_step=int((paging or {}).get("increment", 1)), interval=interval, get=get, serializers=writers, filters=filters, needed=frozenset(needed))


def api_source(spark: SparkSession, spec: dict, path: str, vocabulary: str, name: str, types: list[str] = (), get: Callable[[str], str] = fetch) -> WebApiSource:
    """A source whose items are blank nodes of the given classes."""
    api = operation(spec, path, vocabulary, get)
    context = {"@context": {"@type": list(types), **{n: p for p, n in api.inputs.items()}}, "@fallbackPrefix": vocabulary}
    return WebApiSource(spark, api, context, name)
