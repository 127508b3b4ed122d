"""The neighbourhood of a node over HTTP, beside the files of a folder."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial
from http import HTTPStatus
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from graphloom.plans.pipeline import adjacency
from graphloom.sources.catalog import Catalog

ENDPOINT = "/api/adjacency"


class Handler(SimpleHTTPRequestHandler):
    def __init__(self, find: Callable[[str], dict | None], *args, **kwargs) -> None:
        self.find = find
        super().__init__(*args, **kwargs)

    def do_GET(self) -> None:
        at = urlparse(self.path)
        if at.path != ENDPOINT:
            super().do_GET()
            return
        node = (parse_qs(at.query).get("node_id") or [""])[0].strip()
        found = self.find(node) if node else None
        if found is None:
            status = HTTPStatus.NOT_FOUND if node else HTTPStatus.BAD_REQUEST
            self.send_error(status, "node not found" if node else "missing query param: node_id")
            return
        body = json.dumps(found, ensure_ascii=False).encode()
        self.send_response(HTTPStatus.OK)
        for name, value in (("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(body))),
                            ("Cache-Control", "public, max-age=300")):
            self.send_header(name, value)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args) -> None:
        pass


def server(catalog: Catalog, folder: str, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A threaded server of ``folder`` and of ENDPOINT?node_id=...; call its ``serve_forever``."""
    return ThreadingHTTPServer((host, port), partial(Handler, partial(adjacency, catalog), directory=folder))
