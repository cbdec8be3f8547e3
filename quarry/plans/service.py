"""The engine behind HTTP: a WSGI application that answers in JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from urllib.parse import parse_qs

from quarry.plans.engine import Engine


def application(engine: Engine) -> Callable[[dict, Callable], Iterable[bytes]]:
    """/search?q=...&limit=10&method=bm25 and /stats; for wsgiref.simple_server or any other WSGI server."""

    def answer(environ: dict) -> tuple[str, str]:
        asked = {k: v[-1] for k, v in parse_qs(environ.get("QUERY_STRING", ""), keep_blank_values=True).items()}
        path = environ.get("PATH_INFO", "")
        if path.rstrip("/").endswith("/stats"):
            return "200 OK", engine.stats_json().first().response
        if not path.rstrip("/").endswith("/search"):
            return "404 Not Found", json.dumps({"detail": "not found"})
        try:
            return "200 OK", engine.search_json(asked["q"], int(asked.get("limit", 10)), asked.get("method", "bm25")).first().response
        except (KeyError, ValueError) as e:
            return "422 Unprocessable Entity", json.dumps({"detail": f"bad request: {e}"})

    def run(environ: dict, start: Callable) -> Iterable[bytes]:
        status, body = answer(environ)
        start(status, [("Content-Type", "application/json; charset=utf-8")])
        return [body.encode()]

    return run
