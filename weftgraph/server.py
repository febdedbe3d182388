"""A thin HTTP front: POST /query/<name> with the parameters as JSON; updates change the served graph."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .graph import Graph
from .metrics import Metrics
from .plans import dispatch, updates
from .session import staged

_READ, _SHORT, _UPDATE = "interactive_complex_read_", "interactive_short_read_", "interactive_update_"


#: After so many updates the graph is staged and the log begins anew.
KEPT_UPDATES = 1000


class GraphServer:
    """Reads run on the graph as it is when they come. Updates are appended to a log, which a read after them applies once,
    so that plans don't grow with the number of updates."""

    def __init__(self, graph: Graph):
        self.metrics = Metrics()
        self._lock, self._base, self._now, self._log = threading.Lock(), graph, graph, []

    @property
    def graph(self) -> Graph:
        with self._lock:
            if self._now is None:
                self._now = updates.apply(self._base, updates.log_of(self._base.person.sparkSession, self._log))
                if len(self._log) >= KEPT_UPDATES:
                    frames = ({n: staged(df, "served") for n, df in x.items()} for x in (self._now.vertices, self._now.edges))
                    self._base = self._now = Graph(*frames)
                    self._log = []
            return self._now

    def handle(self, path: str, params: dict) -> object:
        name = path.rstrip("/").removeprefix("/query/")
        if name.startswith(_UPDATE):
            op = int(name.removeprefix(_UPDATE)), params
            updates.to_fields(*op)  # a wrong update is an error of its own request
            with self._lock:
                self._log.append(op)
                self._now = None
            return {}
        read = name.replace(_READ, "ic").replace(_SHORT, "is")
        key, f = dispatch.READS[read]
        start = {key: params.get(key, params.get("personId", params.get("messageId", params.get("person1Id"))))}
        if read in ("ic13", "ic14"):
            start[f"person2Id{read[1:].upper().replace('C', 'Q')}EndNode"] = params.get("person2Id")
        limit = {"limit": params.get("limit") or dispatch.HTTP_LIMITS.get(read, 20)}
        return dispatch.answer(read, f(self.graph, {**params, **start, **limit}))

    def serve(self, host: str = "127.0.0.1", port: int = 9000) -> ThreadingHTTPServer:
        """A server that is not started yet; call serve_forever() on it."""
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def _answer(self, status: int, body: object) -> None:
                data = json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self) -> None:
                self._answer(200, {"status": "ok"}) if self.path == "/" else self._answer(404, {"error": "not found", "path": self.path})

            def do_POST(self) -> None:
                started = time.perf_counter()
                try:
                    params = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                    self._answer(200, outer.handle(self.path, params))
                    outer.metrics.add("http_ok")
                except Exception as e:  # the client gets every error
                    outer.metrics.add("http_error")
                    self._answer(500, {"error": str(e)[:500], "path": self.path})
                outer.metrics.record(self.path, round(1e6 * (time.perf_counter() - started)))

            def log_message(self, *args) -> None:
                pass

        return ThreadingHTTPServer((host, port), Handler)
