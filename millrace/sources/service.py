"""A small server of JSON over HTTP around functions of the library, and a source that fetches texts by their address."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans import pattern

Route = Callable[[dict], Any]


def handler(posts: Mapping[str, Route], gets: Mapping[str, Callable[[], Any]]) -> type[BaseHTTPRequestHandler]:
    """POST and GET by path; one request at a time reaches the functions, as they share a session."""
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body: Any) -> None:
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def run(self, routes: Mapping[str, Callable], *values: Any) -> None:
            work = routes.get(self.path.partition("?")[0])
            if work is None:
                return self.reply(404, {"error": "no such path"})
            try:
                with lock:
                    out = work(*values)
            except (ValueError, KeyError, TypeError) as error:
                return self.reply(400, {"error": str(error)})
            return self.reply(200, out)

        def do_GET(self) -> None:
            self.run(gets)

        def do_POST(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                return self.reply(400, {"error": "the body is no JSON"})
            return self.run(posts, body)

        def log_message(self, *_: Any) -> None:
            pass

    return Handler


def server(host: str, port: int, posts: Mapping[str, Route], gets: Mapping[str, Callable[[], Any]] | None = None) -> ThreadingHTTPServer:
    """A server that isn't running yet: serve_forever() runs it, shutdown() ends it. Port 0 takes a free one."""
    return ThreadingHTTPServer((host, port), handler(posts, gets or {}))


class Engine:
    """The library's face over one graph: patterns in, values out."""

    def __init__(self, graph: pattern.Graph, version: str = "1"):
        self.graph, self.version, self.turns = graph, version, 0

    def run_pattern(self, body: dict) -> dict:
        self.turns += 1
        asked = pattern.from_json(json.dumps(body))
        values = [r["value"] for r in pattern.run(self.graph, asked).collect()]  # at most MOST_VALUES rows
        return {"values": values, "explain": pattern.explain(asked, values[0]) if values else None}

    def schema(self) -> dict:
        roles = self.graph.facts.select("predicate", F.explode("participants").alias("p")).groupBy("predicate").agg(F.sort_array(F.collect_set("p.role")).alias("roles"))
        return {r["predicate"]: r["roles"] for r in roles.orderBy("predicate").limit(1000).collect()}  # the page that a reader is shown

    def reset(self, _: dict | None = None) -> dict:
        self.turns = 0
        return {"ok": True}

    def routes(self) -> tuple[dict[str, Route], dict[str, Callable[[], Any]]]:
        return {"/graphql": self.run_pattern, "/reset": self.reset}, {"/schema": self.schema, "/version": lambda: {"version": self.version}}


def fetched(addresses: DataFrame, client: Callable[[], Callable[[str], str | None]]) -> DataFrame:
    """addresses: name, url -> name, text, ok: each address fetched once by a worker. One that fails, or is empty, is a row
    that is not ok; the others go on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = client()
        for frame in frames:
            texts: list[str | None] = []
            for url in frame["url"]:
                try:
                    texts.append(fetch(url) or None)
                except Exception:  # noqa: BLE001 whatever a client raises is a failed address
                    texts.append(None)
            yield pd.DataFrame({"name": frame["name"], "text": texts, "ok": [x is not None for x in texts]})

    return addresses.select("name", "url").mapInPandas(run, "name string, text string, ok boolean")
