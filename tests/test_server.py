import json
import threading
import urllib.error
import urllib.parse
import urllib.request

import pytest

from tessera import testendpoint
from tessera.federation import Federation
from tessera.server import serve
from tessera.sources.remote import SparqlSource, parse_rows
from tessera.sources.triples import TurtleReader, from_turtle
from tessera.terms import DECIMAL, INTEGER, LANG_STRING, STRING, Iri, Lit


@pytest.fixture(scope="module")
def url(spark):
    server = serve(Federation(spark).add_source(from_turtle(spark, '@prefix : <http://e.x/> . :a :p "x, y" .', "d")), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/sparql"
    server.shutdown()


def get(url, accept="", data=None, **params):
    r = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}", data, {"Accept": accept})
    return urllib.request.urlopen(r).read().decode()


QUERY = "SELECT ?s ?o WHERE { ?s <http://e.x/p> ?o }"


def test_formats(url):
    assert json.loads(get(url, query=QUERY))["results"]["bindings"][0]["o"] == {"type": "literal", "value": "x, y"}
    assert get(url, "text/csv", query=QUERY) == 's,o\r\nhttp://e.x/a,"x, y"\r\n'
    assert get(url, output="tsv", query=QUERY) == '?s\t?o\n<http://e.x/a>\t"x, y"\n'
    assert json.loads(get(url, data=urllib.parse.urlencode({"query": "ASK { ?s ?p 1 }"}).encode()))["boolean"] is False


@pytest.mark.parametrize("params,status", [({}, 400), ({"query": "SELECT"}, 400), ({"query": QUERY, "output": "xml"}, 406)])
def test_errors(url, params, status):
    with pytest.raises(urllib.error.HTTPError) as e:
        get(url, **params)
    assert e.value.code == status


def test_service_description(url):
    assert "sd:Service" in get(url, "text/turtle")


PEOPLE = """@prefix : <http://e.x/> . :a :p "x, y" , "tab\\t\\"q\\" ünï 😀" , 5 , 2.5 ; a :C . :b :p "two"@EN ; :q _:z . _:z :r :a ."""


@pytest.fixture(scope="module", params=["ask", "select", None])
def remote(spark, request):
    server = testendpoint.serve(TurtleReader(PEOPLE).triples())
    yield SparqlSource(spark, f"http://127.0.0.1:{server.server_port}/sparql", "far", describe=request.param, batch=2)
    server.shutdown()


EX = "PREFIX : <http://e.x/> "


def both(spark, remote, text):
    """The rows of the query over the remote graph joined with a local one, and over both as one local graph."""
    here = '@prefix : <http://e.x/> . :a :name "Ann" ; :n 1 . :b :name "Bob" ; :n 2 . :c :name "Cid" ; :likes :a , :b .'
    near = from_turtle(spark, here, "near")
    near.index()
    fed = Federation(spark).add_source(near).add_source(remote)
    one = Federation(spark).add_source(from_turtle(spark, here + PEOPLE, "one"))
    return tuple(sorted(map(str, f.query(EX + text, "ntriples").collect())) for f in (fed, one))


@pytest.mark.parametrize("text", [
    "SELECT ?n ?o WHERE { ?x :name ?n . ?x :p ?o }",
    "SELECT ?n ?o WHERE { ?y :likes ?x . ?x :p ?o . ?y :name ?n FILTER(isLiteral(?o)) }",
    "SELECT ?x ?o WHERE { ?x :p ?o ; a :C }",
    "SELECT ?n ?o WHERE { ?x :name ?n OPTIONAL { ?x :q ?z . ?z :r ?o } }",
    'SELECT ?n WHERE { ?x :name ?n ; :p "two"@en }',
    "SELECT ?x WHERE { ?x :none ?o }",
])
def test_remote_endpoint(spark, remote, text):
    got, want = both(spark, remote, text)
    assert got == want


def test_bind_join_asks_in_batches(spark):
    server = testendpoint.serve([(Iri(f"http://e.x/i{i}"), Iri("http://e.x/p"), Lit(str(i), INTEGER)) for i in range(100)])
    remote = SparqlSource(spark, f"http://127.0.0.1:{server.server_port}/sparql", describe=None)
    near = from_turtle(spark, "@prefix : <http://e.x/> . " + " ".join(f":l{i} :to :i{i} ." for i in range(90)), "near")
    near.index()
    got = Federation(spark).add_source(near).add_source(remote).query(EX + "SELECT ?x ?o WHERE { ?x :to ?y . ?y :p ?o }").collect()
    assert sorted(int(r.o) for r in got) == list(range(90))
    server.shutdown()
    assert 3 <= len(server.asked) <= 6 and all(q.count("(<") <= 40 for q in server.asked)


def test_results_of_all_formats():
    tsv = iter(["?a\t?b\n", '<http://x/y>\t"q\\"\\n"@EN\n', "1.5\t\n", '"\\uD83D\\uDE00"^^<http://d>\t_:b\n'])
    want = [[("I", "http://x/y", None, None), ("L", 'q"\n', LANG_STRING, "en")], [("L", "1.5", DECIMAL, None), None], [("L", "😀", "http://d", None), ("B", "_:b", None, None)]]
    assert list(parse_rows("text/tab-separated-values", tsv, ["a", "b"])) == want
    body = '{"head":{"vars":["a"]},"results":{"bindings":[{"a":{"type":"literal","value":"v","xml:lang":"DE"}},{}]}}'
    assert list(parse_rows("application/sparql-results+json", iter([body]), ["a"])) == [[("L", "v", LANG_STRING, "de")], [None]]
    assert list(parse_rows("text/csv", iter(['a,b\r\n"x, y",http://x/y\r\n']), ["a", "b"])) == [[("L", "x, y", STRING, None), ("I", "http://x/y", None, None)]]


def test_a_dead_endpoint_counts_as_empty_where_asked_for(spark, monkeypatch):
    monkeypatch.setattr("time.sleep", lambda s: None)
    dead = SparqlSource(spark, "http://127.0.0.1:9/sparql", "dead")
    fed = Federation(spark, on_source_error="empty").add_source(dead).add_source(from_turtle(spark, '@prefix : <http://e.x/> . :a :p 1 .', "d"))
    assert fed.query(EX + "SELECT ?o WHERE { ?x :p ?o }").count() == 1
