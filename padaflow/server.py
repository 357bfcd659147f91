"""A small HTTP server over :class:`padaflow.service.Service`, on the standard library.

POST /v1/extract {"text", "labels", "min_confidence"}, POST /v1/extract/batch {"texts", ...},
GET /v1/lookup?q=, /v1/labels, /health, /version.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlsplit

from padaflow.service import Service, TooLarge


def answer(service: Service, method: str, target: str, body: bytes = b"") -> tuple[int, Any]:
    """Status and JSON value of a request."""
    url = urlsplit(target)
    try:
        if method == "POST":
            own = json.loads(body or b"{}")
            options = (own.get("labels"), float(own.get("min_confidence", 0.0)))
            if url.path == "/v1/extract":
                return 200, service.extract(own["text"], *options)
            if url.path == "/v1/extract/batch":
                return 200, service.extract_batch(own["texts"], *options)
        elif method == "GET":
            if url.path == "/v1/lookup":
                return 200, service.lookup(parse_qs(url.query).get("q", [""])[0])
            simple = {"/v1/labels": service.labels, "/health": service.health, "/version": service.version}
            if url.path in simple:
                return 200, simple[url.path]()
        return 404, {"detail": "not found"}
    except TooLarge as e:
        return 413, {"detail": str(e)}
    except (KeyError, TypeError, ValueError) as e:
        return 422, {"detail": str(e)}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that isn't started; call its ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, value = answer(service, self.command, self.path, body)
            data = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            origin = self.headers.get("Origin")
            if origin in service.origins or "*" in service.origins:
                self.send_header("Access-Control-Allow-Origin", origin or "*")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _preflight(self) -> None:
            """What a browser asks before a request from another origin."""
            origin = self.headers.get("Origin")
            known = bool(origin) and (origin in service.origins or "*" in service.origins)
            self.send_response(204 if known else 403)
            if known:
                for name, value in (("Origin", origin), ("Methods", "GET, POST, OPTIONS"), ("Headers", "Content-Type")):
                    self.send_header(f"Access-Control-Allow-{name}", value)
                self.send_header("Vary", "Origin")
            self.send_header("Content-Length", "0")
            self.end_headers()

        do_GET = do_POST = _reply  # noqa: N815
        do_OPTIONS = _preflight  # noqa: N815

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
