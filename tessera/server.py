"""A SPARQL endpoint over HTTP: GET and POST on /sparql, with content negotiation."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from . import results
from .federation import Federation
from .plans.parser import ENTAILMENT, ParseError

FORMATS = {"application/sparql-results+json": "json", "application/json": "json", "text/csv": "csv", "text/tab-separated-values": "tsv"}


DESCRIPTION = """@prefix sd: <http://www.w3.org/ns/sparql-service-description#> .
[] a sd:Service ; sd:endpoint <> ; sd:supportedLanguage sd:SPARQL11Query ; sd:feature sd:UnionDefaultGraph ;
  sd:resultFormat <http://www.w3.org/ns/formats/SPARQL_Results_JSON> , <http://www.w3.org/ns/formats/SPARQL_Results_CSV> , <http://www.w3.org/ns/formats/SPARQL_Results_TSV> .
"""


def answer(fed: Federation, params: dict[str, list[str]], accept: str = "") -> tuple[int, str, Iterator[str]]:
    """(status, media type, pieces of the body). Rows come from Spark one partition after the other, as they are read.

    Without a query, a client that asks for Turtle gets the service's description.
    """
    text = next(iter(params.get("query", [])), None)
    if text is None and "turtle" in accept:
        return 200, "text/turtle", iter([DESCRIPTION])
    if text is None:
        return 400, "text/plain", iter(["the parameter query is missing"])
    wanted = next(iter(params.get("output", [])), "") or next((FORMATS[a] for x in accept.split(",") if (a := x.split(";")[0].strip()) in FORMATS), "json")
    if wanted not in ("json", "csv", "tsv"):
        return 406, "text/plain", iter([f"no such format: {wanted}"])
    try:
        q = fed.plan(text)
    except ParseError as e:
        return 400, "text/plain", iter([str(e)])
    q.reasoning |= any(g.startswith(ENTAILMENT) for g in params.get("default-graph-uri", []))
    r = fed.compile(q)
    media = next(m for m, f in FORMATS.items() if f == wanted)
    if wanted == "json":
        return 200, media, results.json_pieces(r, q.form == "ASK")
    lines, header, end = (results.csv_lines(r), results.csv_header(r), "\r\n") if wanted == "csv" else (results.tsv_lines(r), results.tsv_header(r), "\n")
    return 200, media, (line + end for line in itertools.chain([header], (x["value"] for x in lines.toLocalIterator())))


def serve(fed: Federation, address: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is ready for serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, params: dict) -> None:
            if urlsplit(self.path).path.rstrip("/") not in ("/sparql", "/sparql/query"):
                status, media, body = 404, "text/plain", iter(["try /sparql"])
            else:
                try:
                    status, media, body = answer(fed, params, self.headers.get("Accept", ""))
                    body = itertools.chain([*itertools.islice(body, 2)], body)  # what fails at once is told
                except Exception as e:  # noqa: BLE001 - the client is told
                    status, media, body = 500, "text/plain", iter([str(e)])
            self.send_response(status)
            self.send_header("Content-Type", f"{media}; charset=utf-8")
            self.send_header("Connection", "close")  # ends the body, whose length isn't known before
            self.end_headers()
            for piece in body:
                self.wfile.write(piece.encode())
            self.close_connection = True

        def do_GET(self) -> None:  # noqa: N802
            self._reply(parse_qs(urlsplit(self.path).query))

        def do_POST(self) -> None:  # noqa: N802
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            direct = self.headers.get("Content-Type", "").startswith("application/sparql-query")
            self._reply(parse_qs(urlsplit(self.path).query) | ({"query": [body]} if direct else parse_qs(body)))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((address, port), Handler)
