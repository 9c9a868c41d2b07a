"""The query service: a façade of the search, trend and graph queries, and a JSON-RPC 2.0 server over it."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import graph, search

log = logging.getLogger(__name__)


class Service:
    """``safety`` is an argument of each call, so that calls do not see each other's."""

    def __init__(self, index: search.Index, urls: DataFrame, ranks: DataFrame, edges: DataFrame, trends: DataFrame, news: tuple[search.Index, DataFrame] | None = None, blocked: list[str] | None = None, now: Callable = F.current_timestamp) -> None:
        """urls: (key, url); ranks: (node, rank) of domains; edges: the domain graph; trends: (rank, word); news: its index and (key, url, pub_date)."""
        self.index, self.urls, self.ranks, self.edges, self.trends = index, urls, ranks, edges, trends
        self.news, self.blocked, self.now = news, blocked or [], now

    def ping(self) -> str:
        return "pong"

    def _page(self, hits: DataFrame, page_rank: bool) -> list[list[str]]:
        named = hits.join(self.urls, self.index.key)
        best = search.rerank_by_domain(named, self.ranks) if page_rank else search.top_hits(named, "url")
        return [[r["url"], ""] for r in best.orderBy(F.desc("score"), "url").collect()]

    def normal_search(self, text: str, safety: bool = False, page_rank: bool = False) -> list[list[str]]:
        return self._page(search.simple_search(self.index, text, blocked=self.blocked if safety else None), page_rank)

    def advance_search(self, must: list[str], must_not: list[str], should: list[str], safety: bool = False, page_rank: bool = False) -> list[list[str]]:
        """Blank strings, which forms send for empty boxes, are dropped."""
        return self._page(search.advanced_search(self.index, must, must_not, should, blocked=self.blocked if safety else None), page_rank)

    def news_search(self, query: str) -> list[list[str]]:
        if self.news is None:
            return []
        index, rows = self.news
        hits = search.news_search(index, rows, query, self.now()).join(rows.select(index.key, "url"), index.key)
        return [[r["url"], str(r["pub_date"])] for r in hits.orderBy(F.desc("score"), "url").collect()]

    def keywords(self) -> list[list[str]]:
        return [[r["word"], ""] for r in self.trends.orderBy("rank").limit(10).collect()]

    def get_sink(self, domain: str) -> list[list]:
        return [[r["node"], r["weight"]] for r in graph.out_neighbors(self.edges, domain).orderBy("node").toLocalIterator()]

    def get_source(self, domain: str) -> list[list]:
        return [[r["node"], r["weight"]] for r in graph.in_neighbors(self.edges, domain).orderBy("node").toLocalIterator()]

    #: Method names of the JSON-RPC interface.
    METHODS = {"ping": "ping", "normalSearch": "normal_search", "advanceSearch": "advance_search", "newsSearch": "news_search", "keywords": "keywords", "getSink": "get_sink", "getSource": "get_source"}

    def handle(self, body: str) -> str:
        """The response to a JSON-RPC 2.0 request. A failed search is logged and answers with an empty list."""
        answer: dict = {"jsonrpc": "2.0", "id": None}
        try:
            request = json.loads(body)
            answer["id"] = request.get("id")
        except (ValueError, AttributeError):
            return json.dumps(answer | {"error": {"code": -32700, "message": "Parse error"}})
        name = self.METHODS.get(request.get("method"))
        if name is None:
            return json.dumps(answer | {"error": {"code": -32601, "message": "Method not found"}})
        params = request.get("params", [])
        try:
            answer["result"] = getattr(self, name)(**params) if isinstance(params, dict) else getattr(self, name)(*params)
        except TypeError as e:
            answer["error"] = {"code": -32602, "message": str(e)}
        except Exception:
            log.exception("%s failed", name)
            answer["result"] = []
        return json.dumps(answer)


def serve(service: Service, port: int = 6060) -> ThreadingHTTPServer:
    """A server on any path, open to all origins; the caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, body: bytes) -> None:
            self.send_response(200)
            for k, v in (("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Headers", "*"), ("Content-Type", "application/json"), ("Content-Length", str(len(body)))):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def do_OPTIONS(self) -> None:  # noqa: N802
            self._send(b"")

        def do_POST(self) -> None:  # noqa: N802
            self._send(service.handle(self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()).encode())

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
