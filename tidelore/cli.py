"""Command line: `python -m tidelore.cli COMMAND STORE ...`."""

from __future__ import annotations

import argparse
import os
import subprocess
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import artifacts
from .sources import chat
from .store import Store, exists


def session() -> SparkSession:
    return SparkSession.builder.appName("tidelore").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelore")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **options: object) -> None:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, v in options.items():
            kind = {"action": "store_true"} if v is False else {"type": type(v), "default": v} if v is not None else {}
            c.add_argument(f"--{k.replace('_', '-')}", **kind)

    command("create", "store", title="Untitled", codec="zstd", overwrite=False, block_turns=16)
    for name in ("build", "quick"):
        command(name, "source", output=None, overwrite=False, title="Untitled", format="auto", role="user", task="Continue", budget=600, recent=2)
    for name in ("import-jsonl", "import-chat", "import-file"):
        command(name, "store", "source", format="auto", role="user", session="main")
    command("append", "store", "role", "text", session="main")
    command("search", "store", "query", limit=8, entries_only=False)
    command("resume", "store", "task", budget=1000, recent=2)
    for name in ("inspect", "verify", "compact"):
        command(name, "store")
    command("new-session", "store", title="")
    command("add-entry", "store", "kind", "text", session="main")
    command("attach", "store", "file")
    command("get", "store", "id")
    command("extract-attachment", "store", "id", "output")
    command("export", "store", "output", format="jsonl")
    command("daemon", "store", host="127.0.0.1", port=8765)
    command("proxy", "store", "upstream", host="127.0.0.1", port=8766, mode="auto", threshold=6000, recent=2, budget=1000)
    w = sub.add_parser("wrap")
    w.add_argument("store")
    w.add_argument("argv", nargs=argparse.REMAINDER)
    return p


def _import(store: Store, source: str, kind: str, role: str, sid: str) -> str:
    """Imports a file, or standard input for `-`; returns a line about it."""
    if source == "-":
        items = chat.from_text(store.spark.createDataFrame([(sys.stdin.read(),)], "value string"), kind, role, sid)
    else:
        items = chat.read_chat(store.spark, source, kind, role, sid)
    done = store.import_items(items)
    return f"{done['turns']} turns, {done['new_turns']} new, {done['atoms']} atoms"


def show_hits(hits: DataFrame) -> None:
    for r in hits.orderBy("query_id", "rank").collect():  # at most `limit` rows a query
        print(f"{r['score']:.4f} [{r['kind']} {r['hit_type'][0].upper()}{r['hit_id']}] {r['content'][:300]}")


def wrap(store: Store, argv: list[str]) -> int:
    """Runs a command and records its start and its end as tool turns."""
    store.append_turn("tool", "Running: " + " ".join(argv))
    done = subprocess.run(argv, capture_output=True, text=True)
    store.append_turn("tool", f"Finished: {' '.join(argv)}\nexit code {done.returncode}\nSTDOUT:\n{done.stdout}\nSTDERR:\n{done.stderr}")
    return done.returncode


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = session()
    if a.command == "create":
        Store.create(spark, a.store, a.title, a.codec, a.overwrite, a.block_turns)
        return 0
    if a.command in ("build", "quick"):
        store = Store.create(spark, a.output or a.source.rsplit(".", 1)[0] + ".store", a.title, overwrite=a.overwrite)
        print(store.path, _import(store, a.source, a.format, a.role, "main"))
        if a.command == "quick":
            print(store.resume(a.task, a.budget, a.recent))
        return 0
    if a.command in ("daemon", "proxy", "wrap") and not exists(a.store):
        Store.create(spark, a.store)
    store = Store(spark, a.store)
    if a.command.startswith("import-"):
        print(_import(store, a.source, "jsonl" if a.command == "import-jsonl" else a.format, a.role, a.session))
    elif a.command == "append":
        print(store.append_turn(a.role, sys.stdin.read() if a.text == "-" else a.text, a.session))
    elif a.command == "search":
        show_hits(store.search(spark.createDataFrame([(0, a.query)], "query_id int, query string"), a.limit, evidence=not a.entries_only))
    elif a.command == "resume":
        print(store.resume(a.task, a.budget, a.recent))
    elif a.command == "inspect":
        for k, v in store.stats().items():
            print(f"{k}: {v}")
    elif a.command == "verify":
        problems = store.verify()
        print("\n".join(problems) or "ok")
        return int(bool(problems))
    elif a.command == "compact":
        store.compact()
    elif a.command == "new-session":
        print(store.new_session(a.title))
    elif a.command == "add-entry":
        print(store.add_entry(a.kind, a.text, a.session))
    elif a.command == "attach":
        print(store.attach(a.file))
    elif a.command == "get":
        for k, v in store.get(a.id).items():
            print(f"{k}: {v}")
    elif a.command == "extract-attachment":
        print(artifacts.restore(store.table("attachments"), int(a.id.lstrip("Aa")), a.output))
    elif a.command == "export":
        (store.export_markdown if a.format == "markdown" else store.export_jsonl)(a.output)
    elif a.command == "wrap":
        return wrap(store, a.argv)
    elif a.command == "daemon":
        from .server import serve

        serve(store, a.host, a.port)
    elif a.command == "proxy":
        from .server import serve, upstream

        serve(store, a.host, a.port, send=upstream(a.upstream, os.environ.get("UPSTREAM_API_KEY", "")), mode=a.mode, threshold=a.threshold, recent=a.recent, budget=a.budget)
    return 0


if __name__ == "__main__":
    sys.exit(main())
