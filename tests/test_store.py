"""The store end to end: append, dedupe, search, resume, attach, compact, verify, stream, serve."""

import io
import json
import random
import re
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from tidelore import cli
from tidelore.operators import artifacts
from tidelore.operators.excerpt import excerpts
from tidelore.server import make_server
from tidelore.sources import chat
from tidelore.store import Store
from tidelore.streaming.append import stream_append

CHAT = "User: We decided that the engine is called Longspool.\nAssistant: The name means it keeps whole histories.\nUser: It must run on Spark 4 without a server.\nUser: Do not drop any turn."


@pytest.fixture()
def store(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"), "Demo")
    path = tmp_path / "chat.md"
    path.write_text(CHAT)
    assert s.append(chat.read_chat(spark, str(path))) == 4
    return s


def test_store(spark, store, tmp_path):
    assert store.append(chat.read_chat(spark, str(tmp_path / "chat.md"))) == 0
    kinds = {r["kind"] for r in store.entries().collect()}
    assert {"DECISION", "REQUIREMENT", "WARNING"} <= kinds
    packet = store.resume("Continue the Longspool engine")
    assert "Longspool" in packet and "Project: Demo" in packet
    note = tmp_path / "n.md"
    note.write_text("Notes on the Longspool reader.")
    assert store.attach(str(note)) == store.attach(str(note)) == 1
    hits = store.search(spark.createDataFrame([(0, "Longspool reader")], "query_id int, query string")).collect()
    assert {"entry", "turn", "attachment"} & {h["hit_type"] for h in hits}
    before = sorted(r["turn_id"] for r in store.table("turns").collect())
    store.compact()
    assert sorted(r["turn_id"] for r in store.table("turns").collect()) == before == [1, 2, 3, 4]
    assert store.verify() == [] and store.stats()["turns"] == 4
    assert store.add_entry("FACT", "Longspool stores Parquet tables.") > 0


def test_stream(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"))
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"role":"user","content":"hello there one"}\n{"role":"ai","content":"hi two"}\n{"role":"user","content":"hello there one"}\n')
    stream_append(spark, str(src), s, str(tmp_path / "cp")).awaitTermination()
    assert [(r["turn_id"], r["role"]) for r in s.table("turns").orderBy("turn_id").collect()] == [(1, "user"), (2, "assistant")]


def test_server(store):
    seen = []

    def send(body):
        seen.append(body["messages"])
        return {"choices": [{"message": {"content": [{"type": "text", "text": "Longspool answers."}]}}]}

    server = make_server(store, send=send, threshold=30, recent=1)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def post(path, body):
        return urllib.request.urlopen(urllib.request.Request(base + path, body if isinstance(body, bytes) else json.dumps(body).encode()))

    def refused(path, body):
        with pytest.raises(urllib.error.HTTPError) as e:
            post(path, body)
        return e.value.code

    got = json.loads(post("/append-many", {"messages": [{"role": "user", "content": ["A fifth", {"text": "turn"}]}, 7, {"role": "ai", "text": "sixth"}]}).read())
    assert got["turn_ids"] == [5, 6] and [u["turn_id"] for u in got["updates"]] == [5, 6]
    reply = post("/get", {"id": "t5"})
    assert json.loads(reply.read())["result"]["content"] == "A fifth\nturn" and reply.headers["Access-Control-Allow-Origin"] == "*"
    assert refused("/get", {"id": "x1"}) == 400 and refused("/append", b"{not json") == 400 and refused("/nowhere", {}) == 404
    assert refused("/v1/chat/completions", {"stream": True, "messages": []}) == 400
    chat_body = {"model": "m", "messages": [{"role": "user", "content": "word " * 60}, {"role": "assistant", "content": "ok"}, {"role": "user", "content": "What is Longspool?"}]}
    assert json.loads(post("/v1/chat/completions", chat_body).read())["choices"]
    assert seen[0][0]["role"] == "system" and "Longspool" in seen[0][0]["content"] and seen[0][1:] == chat_body["messages"][1:]
    assert store.table("turns").filter("content = 'Longspool answers.' and role = 'assistant'").count() == 1
    server.shutdown()


def test_lines_and_documents(spark, tmp_path):
    lines, doc = tmp_path / "a.jsonl", tmp_path / "b.json"
    lines.write_text('{"role":"user","text":"one","timestamp":"t","created_at":"c"}\n\n{"role":"ai","content":"two","extract":false}\n')
    got = [(r["pos"], r["role"], r["content"], r["created_at"], r["extract"]) for r in chat.read_chat(spark, str(lines), "jsonl").orderBy("pos").collect()]
    assert got == [(1, "user", "one", "c", True), (3, "assistant", "two", None, False)]
    lines.write_text('{"author":"user","content":"one"}')
    with pytest.raises(Exception, match="requires role and content"):
        chat.read_chat(spark, str(lines), "jsonl").collect()
    doc.write_text(json.dumps({"messages": [{"author": "user", "content": ["a", {"text": "b"}], "timestamp": "t"}, {"speaker": "ai", "message": "c"}]}))
    assert [(r["role"], r["content"], r["created_at"]) for r in chat.read_chat(spark, str(doc)).orderBy("pos").collect()] == [("user", "a\nb", "t"), ("assistant", "c", None)]


def test_get_verify_meta(spark, store, tmp_path):
    raw = bytes(range(256)) * 9
    (tmp_path / "x.bin").write_bytes(raw)
    a = store.attach(str(tmp_path / "x.bin"))
    assert artifacts.restore(store.table("attachments"), a, str(tmp_path / "out" / "x")) == len(raw) and (tmp_path / "out" / "x").read_bytes() == raw
    assert store.get("T1")["role"] == "user" and store.get(f"A{a}")["filename"] == "x.bin" and store.get("e1")["kind"]
    with pytest.raises(KeyError):
        store.get("T99")
    store.set_meta("owner", "nobody")
    assert store.meta("owner") == "nobody" and store.meta("else", "-") == "-" and store.table("turns").count() == 4
    stats = store.stats()
    assert stats["title"] == "Demo" and stats["file_bytes"] > stats["block_payload_compressed_bytes"] > 0 and stats["file_to_raw_ratio"] > 0
    before = store.manifest()["version"]
    store.entries(), store.entries()
    assert store.manifest()["version"] == before  # the fold is stored, not made again
    bad = store.table("turns").withColumn("content", F.when(F.col("turn_id") == 2, "changed").otherwise(F.col("content")))
    store._commit({"turns": [store._write(bad, "turns")], **{t: [store._write(store.table(t), t)] for t in ("atoms", "attachments", "sessions")}}, replace=True)
    assert store.verify() == ["turn 2: hash mismatch"]
    with pytest.raises(ValueError):
        store.get("T2")


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    source, out = tmp_path / "chat.md", str(tmp_path / "made")
    source.write_text(CHAT)
    with pytest.raises(ValueError):
        cli.main(["create", out, "--codec", "lzma"])
    assert cli.main(["build", str(source), "--output", out]) == 0
    assert "4 turns, 4 new" in capsys.readouterr().out
    with pytest.raises(Exception, match="(?i)exist"):
        cli.main(["build", str(source), "--output", out])
    assert cli.main(["quick", str(source), "--output", out, "--overwrite", "--task", "Longspool"]) == 0
    assert "Longspool" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", io.StringIO("A turn from a pipe"))
    assert cli.main(["append", out, "user", "-"]) == 0 and cli.main(["wrap", out, "echo", "hello"]) == 0
    assert cli.main(["export", out, str(tmp_path / "md"), "--format", "markdown"]) == 0
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "md")).collect())
    assert "# Untitled" in text and "## User · T5" in text and "exit code 0" in text
    assert cli.main(["search", out, "Longspool"]) == 0 and cli.main(["get", out, "T1"]) == 0 and cli.main(["verify", out]) == 0
    assert "engine is called" in capsys.readouterr().out


def test_full_width_queries_find_turns(spark, store):
    hits = store.search(spark.createDataFrame([(0, "\uff2c\uff4f\uff4e\uff47\uff53\uff50\uff4f\uff4f\uff4c")], "query_id int, query string")).collect()
    assert hits and all("Longspool" in h["content"] for h in hits[:1])


def test_hits_and_packets_hold_excerpts(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "long"))
    filler = " ".join(f"Sentence number {i} talks about plain weather again." for i in range(60))
    s.append_turn("assistant", f"{filler} The Quillgate protocol means that packets are sorted. {filler}")
    hit = s.search(spark.createDataFrame([(0, "Quillgate protocol")], "query_id int, query string")).filter("hit_type = 'turn'").first()
    assert "Quillgate protocol means" in hit["content"] and len(hit["content"]) <= 820
    assert "Quillgate protocol means" in s.resume("Quillgate protocol")


def plain_excerpt(parts, scores, room, most=4):
    """Sentences by score, then in their order while they fit."""
    out, used = [], 0
    for i in sorted(sorted(range(len(parts)), key=lambda i: (-scores[i], i))[:most]):
        extra = len(parts[i]) + bool(out)
        if used + extra > room:
            if room - used > 40:
                out.append(parts[i][: room - used - 3] + "...")
            break
        out.append(parts[i])
        used += extra
    return "\n".join(out)


def test_excerpts_pack_like_the_plain_rule(spark):
    rng = random.Random(3)
    words = ["amber", "birch", "cobalt", "delta", "ember", "fjord", "gravel", "harbor"]
    texts = [" ".join(" ".join(rng.choices(words, k=rng.randint(3, 30))).capitalize() + "." for _ in range(rng.randint(4, 14))) for _ in range(25)]
    rows = [(i, 0, t) for i, t in enumerate(texts)] + [(100, 0, "short"), (101, 0, ""), (102, 0, "x" * 500)]
    df = spark.createDataFrame(rows, "id int, query_id int, content string")
    got = {r["id"]: r["excerpt"] for r in excerpts(df, ["id"], spark.createDataFrame([(0, "amber")], "query_id int, query string"), 300).collect()}
    assert got[100] == "short" and got[101] == "" and got[102] == "x" * 297 + "..."
    for i, t in enumerate(texts):
        if len(t) > 300:
            parts = re.split(r"(?<=[.])\s+(?=[A-Z0-9])", t)
            scores = [2.0 * ("amber" in p.lower()) for p in parts]  # one term: covered or not, named or not
            assert got[i] == plain_excerpt(parts, scores, 300)
        else:
            assert got[i] == t
