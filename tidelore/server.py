"""A small HTTP service over a store, with an optional chat proxy; requests are served one after another."""

from __future__ import annotations

import json
import threading
import urllib.request
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .operators.resume import forwarded
from .sources.chat import message_text, response_text
from .store import Store

TIMEOUT = 120


class Unanswerable(ValueError):
    """A request that the service refuses."""


def upstream(url: str, key: str = "") -> Callable[[dict], dict]:
    """Posts chat completions to a compatible server."""

    def send(body: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(url, json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=TIMEOUT) as reply:
            return json.loads(reply.read())

    return send


class Service:
    """What the routes do; `send` forwards chat completions."""

    def __init__(self, store: Store, send: Callable[[dict], dict] | None = None, mode: str = "auto", threshold: int = 6000, recent: int = 2, budget: int = 1000) -> None:
        self.store, self.send = store, send
        self.mode, self.threshold, self.recent, self.budget = mode, threshold, recent, budget

    def append(self, body: dict) -> dict:
        content = message_text(body.get("content")) or message_text(body.get("text"))
        turn = self.store.append_turn(body.get("role") or "user", content, body.get("session_id") or "main", body.get("extract", True))
        return {"ok": True, "turn_id": turn}

    def append_many(self, body: dict) -> dict:
        updates = [self.append({"session_id": body.get("session_id"), **m}) for m in body.get("messages") or body.get("turns") or [] if isinstance(m, dict)]
        return {"ok": True, "turn_ids": [u["turn_id"] for u in updates], "updates": updates}

    def resume(self, body: dict) -> dict:
        return {"ok": True, "packet": self.store.resume(body.get("task") or "continue", int(body.get("budget") or 1000), int(body.get("recent") or 2))}

    def search(self, body: dict) -> dict:
        q = self.store.spark.createDataFrame([(0, body.get("query") or "")], "query_id int, query string")
        return {"ok": True, "hits": [r.asDict() for r in self.store.search(q, int(body.get("limit") or 8)).orderBy("rank").collect()]}

    def get(self, body: dict) -> dict:
        return {"ok": True, "result": self.store.get(str(body.get("id") or ""))}

    def attach(self, body: dict) -> dict:
        return {"ok": True, "attachment_id": self.store.attach(body["path"], body.get("source_turn_id"))}

    def complete(self, body: dict) -> dict:
        """Records the messages, forwards them or a packet in their place, and records the answer."""
        if self.send is None:
            raise Unanswerable("no upstream is set")
        if body.get("stream"):
            raise Unanswerable("streaming is not supported")
        messages = [m for m in body.get("messages") or [] if isinstance(m, dict)]
        for m in messages:
            if text := message_text(m.get("content")).strip():
                self.store.append_turn(m.get("role") or "user", text)
        rows = [(0, i, str(m.get("role") or "user"), message_text(m.get("content"))) for i, m in enumerate(messages)]
        frame = self.store.spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
        choice = forwarded(frame, self.mode, self.threshold, self.recent).first()
        if choice is not None and choice["replaced"]:
            packet = self.store.resume(choice["task"], self.budget, self.recent)
            messages = [{"role": "system", "content": packet}] + [messages[m["turn"]] for m in choice["messages"]]
        reply = self.send({**body, "messages": messages})
        if text := response_text(reply).strip():
            self.store.append_turn("assistant", text)
        return reply

    def routes(self) -> dict[str, Callable[[dict], dict]]:
        own = {"/append": self.append, "/append-many": self.append_many, "/resume": self.resume, "/search": self.search, "/get": self.get, "/attach": self.attach}
        return own | ({"/v1/chat/completions": self.complete} if self.send else {})


def make_server(store: Store, host: str = "127.0.0.1", port: int = 0, send: Callable[[dict], dict] | None = None, **options: object) -> ThreadingHTTPServer:
    lock = threading.Lock()
    posts = Service(store, send, **options).routes()
    gets = {"/": lambda _: {"ok": True, "paths": [*posts, "/health", "/stats"]}, "/health": lambda _: {"ok": True}, "/stats": lambda _: store.stats()}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_: object) -> None:
            pass

        def reply(self, code: int, out: dict | None = None) -> None:
            raw = b"" if out is None else json.dumps(out, ensure_ascii=False, default=str).encode()
            self.send_response(code)
            for name, value in (("Origin", "*"), ("Methods", "GET, POST, OPTIONS"), ("Headers", "Content-Type, Authorization")):
                self.send_header(f"Access-Control-Allow-{name}", value)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def answer(self, routes: dict, failed: int) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            run = routes.get(self.path.split("?")[0])
            if run is None:
                return self.reply(404, {"ok": False, "error": "not found"})
            try:
                body = json.loads(raw or b"{}")
                if not isinstance(body, dict):
                    raise Unanswerable("the body must be an object")
                with lock:
                    out = run(body)
            except Exception as e:
                return self.reply(failed, {"ok": False, "error": str(e)[:500]})
            return self.reply(200, out)

        def do_OPTIONS(self) -> None:
            self.reply(204)

        def do_GET(self) -> None:
            self.answer(gets, 500)

        def do_POST(self) -> None:
            self.answer(posts, 400)

    return ThreadingHTTPServer((host, port), Handler)


def serve(store: Store, host: str, port: int, **options: object) -> None:
    make_server(store, host, port, **options).serve_forever()
