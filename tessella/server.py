"""HTTP: GET /health and GET /search, each request in its own thread."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .functions.filters import parse_filters
from .index import Index

MODES = ("grep", "semantic", "hybrid")


def run_search(index: Index, q: str, mode: str = "grep", n: int = 10, source: str | None = None, filters: list[str] | None = None, after: str | None = None, before: str | None = None, context: int = 300, full: bool = False, scores: bool = True, metadata: bool = False, docs: DataFrame | None = None) -> dict:
    """{"results": [...]} of one search; a wrong mode, filter or date is a ValueError.

    `docs` are what a substring search reads where nothing is indexed yet."""
    if mode not in MODES:
        raise ValueError(f"Invalid mode: {mode!r}")
    options = {"source": source, "filters": parse_filters(filters) or None, "after": T.parse_date(after) if after else None, "before": T.parse_date(before) if before else None}
    # Filters and dates go below every top-k, so no more has to be fetched for them.
    if mode == "grep":
        of = index.chunks() if docs is None or index.exists() else docs
        rows = index.grep(q, n, context, docs, **options).join(of.select("id", "content"), "id")
    elif mode == "semantic":
        rows = index.semantic(index._one(q), n, **options)
    else:
        rows = index.search(index._one(q), top_k=n, pool=max(4 * n, 20), **options)
    if mode != "grep":
        rows = rows.withColumn("title", T.short_title(F.col("title"))).withColumn("snippet", T.snippet(F.col("content"), context, q))
    rows = rows.orderBy("rank")
    out = []
    found = rows.collect()  # n rows
    for r in found:
        d = r.asDict()
        x = {"rank": d["rank"], "id": d["id"], "source": d["source"], "title": d["title"]}
        if scores and mode == "semantic":
            x["score"] = round(d["score"], 3)
        elif scores and mode == "hybrid":
            x |= {k: round(d[f"{k}_score"] or 0.0, 3) for k in ("rerank", "rrf", "dense", "bm25") if f"{k}_score" in d}
        if full:
            x["content"] = d["content"]
        elif context > 0:
            x["snippet"] = d["snippet"]
        if metadata:
            x["metadata"] = {k: v["s"] for k, v in (d["metadata"] or {}).items()}
        out.append(x)
    return {"results": out} | ({"total_matches": found[0]["total_matches"] if found else 0} if mode == "grep" else {})


def _flag(p: dict, name: str, default: bool) -> bool:
    return p[name][0].lower() in ("1", "true", "yes") if name in p else default


def handle(index: Index, path: str, search=run_search) -> tuple[int, dict]:
    """Status and body of a GET."""
    u = urlsplit(path)
    p = parse_qs(u.query, keep_blank_values=True)
    if u.path == "/health":
        return 200, {"status": "ok"}
    if u.path != "/search":
        return 404, {"error": "not found"}
    if "q" not in p:
        return 400, {"error": "q is missing"}
    one = lambda k, d=None: p[k][0] if k in p and p[k][0] else d
    try:
        return 200, search(index, p["q"][0], one("mode", "grep"), int(one("n", "10")), source=one("source"), filters=p.get("filter"), after=one("after"), before=one("before"), context=int(one("context", "300")), full=_flag(p, "full", False), scores=_flag(p, "scores", True), metadata=_flag(p, "metadata", False))
    except ValueError as e:
        return 400, {"error": str(e)}
    except Exception as e:  # the service goes on
        return 500, {"error": type(e).__name__}


def serve(index: Index, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, body = handle(index, self.path)
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
