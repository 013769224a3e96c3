import json

from tessera.federation import Federation
from tessera.sources.openapi import api_source, operation, serializer
from tessera.sources.triples import from_turtle

SPEC = {
    "host": "h", "basePath": "/v1", "schemes": ["https"],
    "x-paging": {"standard": {"param": "page", "start": 1, "increment": 1}},
    "x-definitions": {"day": {"serializer": "date", "date-format": "dd/MM/yyyy"}},
    "definitions": {"Tender": {"type": "object", "properties": {"id": {"type": "integer"}, "unit": {"type": "object", "properties": {"code": {"type": "string"}}}, "tags": {"type": "array"}}}},
    "paths": {"/tenders/{code}": {"get": {
        "parameters": [
            {"name": "code", "in": "path", "required": True, "x-path": {"path": ["unit", "code"]}, "x-serializer": {"serializer": "only-numbers", "width": 4}},
            {"name": "opened", "in": "query", "x-path": {"path": ["opened"]}, "x-serializer": {"$ref": "#/x-definitions/day"}},
            {"name": "page", "in": "query", "required": True},
        ],
        "responses": {"200": {"schema": {"type": "array", "items": {"$ref": "#/definitions/Tender"}}}},
    }}},
}


def answer(url):
    assert url.startswith("https://h/v1/tenders/0012?opened=31%2F01%2F2024&page=")
    return json.dumps([{"id": 5, "unit": {"code": "12"}}, {"id": 6, "unit": None}] if url.endswith("=1") else [])


def test_operation():
    api = operation(SPEC, "/tenders/{code}", "http://e.x/")
    assert api.columns == {"id": "bigint", "unit.code": "string"} and api.page == "page" and api.template == "https://h/v1/tenders/{code}{?opened,page}"
    assert serializer({"serializer": "only-numbers", "width": 5, "fill": "x"})("a1-2") == "xxx12"


def test_description_as_a_source(spark):
    fed = Federation(spark).add_source(from_turtle(spark, '@prefix : <http://e.x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . :u :key "1-2" ; :day "2024-01-31"^^xsd:date .', "d"))
    fed.add_source(api_source(spark, SPEC, "/tenders/{code}", "http://e.x/", "api", get=answer))
    fed.index_sources()
    got = fed.query("PREFIX : <http://e.x/> SELECT ?i WHERE { :u :key ?k ; :day ?d . ?t :opened ?d ; :id ?i . ?t <http://e.x/unit.code> ?k }").collect()
    assert sorted(r.i for r in got) == [5, 6]


def test_filters_become_parameters(spark):
    """A parameter that restricts a member takes the constant of a filter that implies it, and no other."""
    params = [{"name": "code", "in": "path", "required": True, "x-path": {"path": ["key"]}}, {"name": "from", "in": "query", "x-path": {"path": ["id"], "filter": "$actual >= $input"}}, {"name": "to", "in": "query", "x-path": {"path": ["id"], "filter": "$input > $actual"}}]
    spec = {**SPEC, "x-paging": {}, "paths": {"/t/{code}": {"get": {"parameters": params, "responses": {"200": {"schema": {"type": "array", "items": {"$ref": "#/definitions/Tender"}}}}}}}}
    fed = Federation(spark).add_source(from_turtle(spark, '@prefix : <http://e.x/> . :u :code "1" .', "d")).add_source(api_source(spark, spec, "/t/{code}", "http://e.x/", "api", get=counted))
    fed.index_sources()
    ask = lambda text: sorted(r.i for r in fed.query("PREFIX : <http://e.x/> SELECT ?i WHERE { :u :code ?c . ?t :key ?c ; :id ?i " + text + " }").collect())
    assert ask("FILTER(?i > 3 && ?i < 7)") == [4, 5, 6]  # `to` keeps what is less than 7, `from` what is 3 or more
    assert ask("FILTER(?i <= 2)") == [0, 1, 2] and ask("FILTER(8 <= ?i)") == [8, 9] and ask("FILTER(?i > 3 || ?i < 2)") == [0, 1, *range(4, 10)]


def counted(url):
    asked = {k: int(v) for k, _, v in (x.partition("=") for x in url.partition("?")[2].split("&")) if k}
    assert url.partition("?")[2] in ("from=3&to=7", "from=8", "")
    return json.dumps([{"id": i} for i in range(asked.get("from", 0), asked.get("to", 10))])
