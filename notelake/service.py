"""The index over HTTP and as tools of an assistant: the same calls as ``api.Notes``, with plain JSON in and out.

``GET /api/v1/health`` and ``/ui`` are open to all; ``/api/v1/search``, ``stats``, ``list`` and ``read`` ask for the key.
Errors are ``{"error": {"code", "message"}}`` with 400, 401, 404, 429 or 500. Pages of the origins that the service is
given may call it from a browser.
"""

from __future__ import annotations

import hmac
import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .api import Notes
from .operators.limits import admit
from .plans.search import MODES

#: Most and default rows, and most rows skipped, of a search and of a listing.
SEARCH, LIST, MOST_OFFSET = (200, 20), (200, 50), 10_000
PER_SECOND = 30
ROOT = "/api/v1"
PAGE = """<!doctype html><meta charset="utf-8"><title>Notes</title>
<form><input name="q" autofocus placeholder="search"><input name="key" type="password" placeholder="key"></form><ol></ol>
<script>
document.forms[0].onsubmit = async e => {
  e.preventDefault()
  const f = new FormData(e.target)
  const r = await fetch("/api/v1/search?q=" + encodeURIComponent(f.get("q")), {headers: {"X-API-Key": f.get("key")}})
  const found = await r.json()
  const list = document.querySelector("ol")
  list.replaceChildren(...(found.results || [{file_path: found.error.message, snippet: ""}]).map(x => {
    const item = document.createElement("li")
    item.textContent = x.file_path + ": " + x.snippet
    return item
  }))
}
</script>
"""


class Refused(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def number(q: dict, name: str, default: int, most: int) -> int:
    try:
        return min(max(int(q.get(name, default)), 0), most)
    except ValueError:
        raise Refused(400, f"{name} must be a number") from None


def real(q: dict, name: str) -> float | None:
    try:
        return float(q[name]) if name in q else None
    except ValueError:
        raise Refused(400, f"{name} must be a number") from None


def flag(q: dict, name: str, default: bool = False) -> bool:
    return q[name].lower() in ("1", "true", "yes") if name in q else default


class Service:
    def __init__(self, notes: Notes, token: str | None = None, vaults: dict[str, str] | None = None, origins: tuple[str, ...] = (), synonyms: dict[str, list[str]] | None = None, user_dictionary: set[str] = frozenset()):
        self.notes, self.token, self.vaults, self.origins, self.held = notes, token, vaults or {}, origins, []
        self.words = {"synonyms": synonyms or {}, "user_dictionary": set(user_dictionary)}

    def call(self, path: str, q: dict[str, str], headers) -> dict:
        if path == ROOT + "/health":
            return self.health(q)
        calls = {"/search": self.search, "/stats": self.stats, "/list": self.list, "/read": self.read}
        name = path.removeprefix(ROOT)
        if not path.startswith(ROOT) or name not in calls:
            raise Refused(404, "no such call")
        self.check(headers)
        return calls[name](q)

    def allowed(self, origin: str | None) -> dict[str, str]:
        """Headers for a browser's page of this origin."""
        if not origin or not {origin, "*"} & set(self.origins):
            return {}
        return {"Access-Control-Allow-Origin": origin, "Access-Control-Allow-Methods": "GET, OPTIONS", "Access-Control-Allow-Headers": "Authorization, X-API-Key", "Vary": "Origin"}

    def check(self, headers) -> None:
        """A bearer token comes first, then an API key; at most PER_SECOND calls in any second."""
        bearer = headers.get("Authorization", "")
        given = bearer.removeprefix("Bearer ") if bearer.startswith("Bearer ") else headers.get("X-API-Key", "")
        if self.token and not hmac.compare_digest(given.encode(), self.token.encode()):
            raise Refused(401, "unauthorised")
        (ok,), self.held = admit([time.monotonic_ns() // 1000], PER_SECOND, held=self.held)
        if not ok:
            raise Refused(429, "too many requests")

    def health(self, q: dict) -> dict:
        return {"status": "ok", "version": self.notes.store.version()}

    def search(self, q: dict) -> dict:
        """A page of results; the total counts all matches with the request's filters (Q16)."""
        text, mode = q.get("q", ""), q.get("mode", "hybrid")
        if not text.strip() or mode not in MODES:
            raise Refused(400, "q must not be empty, and mode one of " + ", ".join(MODES))
        limit, offset = number(q, "limit", SEARCH[1], SEARCH[0]), number(q, "offset", 0, MOST_OFFSET)
        filters = {"vault": q.get("vault"), "tag_filter": q.get("tag"), "since_date": q.get("since"), "fuzzy": flag(q, "fuzzy")} | self.words
        knobs = {"alpha": real(q, "alpha"), "min_score": real(q, "min_score"), "mmr": flag(q, "mmr"), "backlinks": flag(q, "backlinks", True)}
        if (balance := real(q, "mmr_lambda")) is not None:
            knobs["mmr_lambda"] = balance
        vector = json.loads(q["vector"]) if "vector" in q else None
        cursor = q.get("cursor")
        offset = 0 if cursor else offset
        out = self.notes.search(text, query_vector=vector, limit=limit + offset, mode=mode, cursor=cursor, **filters, **knobs)
        results = self.notes.show(out, text)[offset:]
        return {"results": results, "count": len(results), "total": self.notes.count(text, **filters), "offset": offset, "limit": limit, "mode": out.mode, "next_cursor": out.next_cursor}

    def stats(self, q: dict) -> dict:
        return json.loads(self.notes.stats().toJSON().first()) | {"db_bytes": self.notes.store.size()}

    def list(self, q: dict) -> dict:
        limit, offset = number(q, "limit", LIST[1], LIST[0]), number(q, "offset", 0, MOST_OFFSET)
        rows = [json.loads(x) for x in self.notes.files(limit, offset).toJSON().collect()]
        return {"files": rows, "count": len(rows), "offset": offset, "limit": limit}

    def read(self, q: dict) -> dict:
        try:
            row = self.notes.read(q.get("vault", "default"), q.get("path", ""), self.vaults).first()
        except ValueError as e:
            raise Refused(400, str(e)) from None
        if row is None:
            raise Refused(404, "no such note")
        return {"vault": row.vault_name, "path": row.file_path, "content": row.text}

    # tools of an assistant

    def search_local_notes(self, query: str, limit: int = 10, mode: str = "hybrid", **knobs) -> str:
        """Results as Markdown blocks."""
        if mode == "vec" and knobs.get("query_vector") is None:
            return "Vector search needs an embedder; use mode fts or hybrid."
        rows = self.notes.show(self.notes.search(query, limit=min(limit, 50), mode=mode, **knobs), query, 3, 800)
        return "\n\n".join(f"### {r['file_path']} ({r['chunk_id']})\n{r['snippet']}" for r in rows) or "No results."

    def get_surrounding_context(self, chunk_id: int, window: int = 2) -> str:
        return self.notes.context(chunk_id, window)

    def index_status(self) -> dict:
        return self.stats({})

    def rebuild_index(self, *, from_scratch: bool = False) -> dict[str, int]:
        """Bring the index up to date, or make it anew (Q20); the number of files by status."""
        if from_scratch:
            self.notes.store.purge()
        return {r.status: r.n for r in self.notes.index(self.vaults).collect()}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_OPTIONS(self):
            self.answer(204, b"", None)

        def do_GET(self):
            at = urlsplit(self.path)
            if at.path == "/ui":
                return self.answer(200, PAGE.encode(), "text/html; charset=utf-8")
            try:
                status, body = 200, service.call(at.path, {k: v[-1] for k, v in parse_qs(at.query).items()}, self.headers)
            except Refused as e:
                status, body = e.status, {"error": {"code": e.status, "message": str(e)}}
            except Exception as e:  # noqa: BLE001  a failed call must not end the server
                status, body = 500, {"error": {"code": 500, "message": type(e).__name__}}
            self.answer(status, json.dumps(body, ensure_ascii=False).encode(), "application/json")

        def answer(self, status: int, data: bytes, kind: str | None) -> None:
            self.send_response(status)
            headers = service.allowed(self.headers.get("Origin")) | ({"Content-Type": kind} if kind else {}) | {"Content-Length": str(len(data))}
            for name, value in headers.items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
