"""Registered queries of the memory engine, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..durable import stored
from ..functions.features import cjk_features, feature_rows, maybe_contains, postings, query_features, sketch_positions, sketches
from ..functions.numbering import numbered
from ..functions.text import anchor_factor, anchor_ratio, any_cue, estimate_tokens, fingerprint, latin_tokens, media_type, normalize_text, sentences, strong_anchors
from ..operators import artifacts, dictionary, excerpt, extract, ingest, resume, search
from ..sources import chat
from ..store import markdown_turn

QUERY = "thon tion erth ndth hean anth of reanti"
#: Literals that no table holds: phrases, a long run, single characters, contrast, question endings.
CJK = ["命名决定", "我们需要测试压测实验的完整流程和记录", "存", "的", "不是工具而是平台", "这个可以吗", "这是一个定义，包括引用和论文", "不能写入", "只能不能", "项目叫做长卷"]
CUES = ["We decided that ", "It must hold: ", "Do not forget: ", "Next step is ", "I want ", ""]
FILES = [("report.pdf", "application/pdf"), ("a.PNG", "image/png"), ("s.mp3", "audio/mpeg"), ("v.mp4", "video/mp4"), ("t.csv", "text/csv"), ("x.bin", "application/octet-stream"), ("n.md", "application/octet-stream"), ("q.yml", ""), ("z.pdf", "")]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _turns(spark: SparkSession, sf: str, cued: bool = False) -> DataFrame:
    """turn_id, session_id, seq, role, content of the conversations table; `cued` puts a cue phrase before each text."""
    c = _read(spark, sf, "conversations")
    text = F.concat(F.element_at(F.array(*[F.lit(x) for x in CUES]), (F.col("turn") % 6 + 1).cast("int")), F.col("text")) if cued else F.col("text")
    rows = c.select("conv_id", "turn", "role", text.alias("text"))
    # The order over all turns numbers them, as the store's ids do; rows without an id come last, as in the SQL.
    return numbered(rows, [F.asc_nulls_last("conv_id"), F.asc_nulls_last("turn")], "turn_id").select("turn_id", F.col("conv_id").alias("session_id"), (F.col("turn") + 1).alias("seq"), "role", normalize_text("text").alias("content"))


def _literals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CJK)), "id long, text string")


def _entries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    turns = stored(_turns(spark, sf, cued=True), "turns")
    events = dictionary.fold(extract.atoms(turns, ["turn_id"]))
    return turns, stored(dictionary.entries(stored(events, "events"))[0], "entries")


def _attachments(spark: SparkSession, sf: str) -> DataFrame:
    d = _read(spark, sf, "documents")
    name = F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".txt"))
    return d.select(F.col("doc_id").alias("attachment_id"), name.alias("filename"), F.lit("text/plain").alias("mime_type"), F.lit("text").alias("media_type"), normalize_text("text").alias("sidecar_text"), F.lit(None).cast("long").alias("source_turn_id"))


def _no_attachments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "attachment_id long, filename string, mime_type string, media_type string, sidecar_text string, source_turn_id long, raw_bytes long")


def _no_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "entry_id long, kind string, content string, authority double, confidence double, source_turn_id long, status string")


def turn_profile(spark, sf):
    t = _turns(spark, sf)
    return t.select("turn_id", F.length("content").alias("chars"), F.octet_length("content").alias("bytes"), estimate_tokens(F.col("content")).alias("tokens"), fingerprint(F.col("content")).alias("sha256"))


def normalized_messy(spark, sf):
    c = _read(spark, sf, "conversations")
    messy = F.concat(F.lit(" \t"), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\r\n\r\n\r\n\n x\r"))
    return c.select("conv_id", "turn", normalize_text(messy).alias("content"))


def turn_dedupe(spark, sf):
    t = _turns(spark, sf)
    twice = t.withColumn("copy", F.lit(0)).unionByName(t.filter("turn_id % 3 = 0").withColumn("copy", F.lit(1)))
    items = twice.select("session_id", (F.col("turn_id") + F.col("copy") * 1_000_000).alias("pos"), "role", "content", F.lit(None).cast("string").alias("created_at"), F.lit(True).alias("extract"))
    return ingest.number_turns(items).select("turn_id", "session_id", "seq", "role", "sha256")


def block_pack(spark, sf):
    t = _turns(spark, sf).withColumn("raw_bytes", F.octet_length("content").cast("long")).withColumn("created_at", F.lit(None).cast("string"))
    return ingest.blocks(t, 3).select("session_id", "block", "first_seq", "last_seq", "first_turn_id", "last_turn_id", "turn_count", "text_bytes")


def role_tokens(spark, sf):
    return _turns(spark, sf).groupBy("role").agg(F.count("*").alias("turns"), F.sum(estimate_tokens(F.col("content"))).alias("tokens"))


def session_stats(spark, sf):
    return _turns(spark, sf).groupBy("session_id").agg(F.count("*").alias("turns"), F.max("seq").alias("last_seq"), F.sum(F.octet_length("content")).alias("bytes"), F.sum(estimate_tokens(F.col("content"))).alias("tokens"))


def store_stats(spark, sf):
    t = _turns(spark, sf).withColumn("raw_bytes", F.octet_length("content").cast("long")).withColumn("estimated_tokens", estimate_tokens(F.col("content"))).withColumn("created_at", F.lit(None).cast("string"))
    e = t.filter("role = 'user'").select(F.col("turn_id").alias("entry_id"), "content", F.when(F.col("turn_id") % 4 == 0, "superseded").otherwise("active").alias("status"))
    a = _attachments(spark, sf).withColumn("raw_bytes", F.octet_length("sidecar_text").cast("long"))
    s = ingest.stats(t, e, a)
    return s.select("turns", "sessions", "raw_message_bytes", "estimated_raw_tokens", "raw_blocks", "all_entries", "active_entries", "entry_text_bytes", "attachments", "attachment_raw_bytes", "estimated_dictionary_tokens", "index_records")


def sentence_split(spark, sf):
    return _turns(spark, sf).select("turn_id", F.posexplode(sentences(F.col("content"))).alias("pos", "sentence"))


def question_flag(spark, sf):
    lit = _literals(spark).select(F.col("id").alias("turn_id"), F.col("text").alias("content"))
    t = _turns(spark, sf).select(F.col("turn_id") + 100, F.concat("content", F.when(F.col("turn_id") % 5 == 0, "?").otherwise("")))
    return lit.union(t).select("turn_id", extract.is_question(F.col("content")).alias("question"))


def _kinds(c: Column) -> list[Column]:
    return [F.coalesce(c["kind"], F.lit("")).alias("kind"), F.coalesce(c["confidence"], F.lit(0.0)).alias("confidence")]


def atom_kind_user(spark, sf):
    t = _turns(spark, sf, cued=True).select("turn_id", "content").union(_literals(spark).select(-F.col("id"), "text"))
    return t.withColumn("c", extract.classify_user(F.col("content"))).select("turn_id", *_kinds(F.col("c")))


def atom_kind_other(spark, sf):
    t = _turns(spark, sf, cued=True).select("turn_id", "content").union(_literals(spark).select(-F.col("id"), "text"))
    return t.withColumn("c", extract.classify_other(F.col("content"))).select("turn_id", *_kinds(F.col("c")))


def fact_candidates(spark, sf):
    t = _turns(spark, sf, cued=True)
    return extract.sentence_atoms(t, ["turn_id"]).filter("kind = 'FACT'").select("turn_id", "pos", "role", "confidence")


def atoms_topk(spark, sf):
    return extract.atoms(_turns(spark, sf, cued=True), ["turn_id"]).select("turn_id", "rank", "kind", "content", "confidence")


def anchors(spark, sf):
    return _turns(spark, sf).select("turn_id", F.explode(strong_anchors(F.col("content"))).alias("anchor"))


def latin_terms(spark, sf):
    t = _turns(spark, sf).select("turn_id", F.explode(latin_tokens(F.col("content"))).alias("t")).select("turn_id", F.col("t.clean").alias("term"))
    return t.groupBy("turn_id", "term").agg(F.count("*").alias("n"))


def cjk_ngrams(spark, sf):
    t = _literals(spark).select("id", F.explode(cjk_features(F.col("text"))).alias("f"))
    return t.groupBy("id", F.col("f.term").alias("term")).agg(F.sum("f.tenths").alias("tenths"))


def features_topk(spark, sf):
    return postings(_turns(spark, sf), ["turn_id"], "content", 64).select("turn_id", "term", F.round("weight", 6).alias("weight"), "rank")


def doc_freq(spark, sf):
    p = postings(_read(spark, sf, "documents").select("doc_id", normalize_text("text").alias("t")), ["doc_id"], "t", 96)
    return p.groupBy("term").agg(F.count("*").alias("df"))


def idf_query(spark, sf):
    p = postings(_turns(spark, sf), ["turn_id"], "content", 64)
    n = _turns(spark, sf).count()
    q = spark.createDataFrame([(0, QUERY)], "query_id int, query string")
    base = query_features(q, ["query_id"], "query")
    terms = search.idf_query_terms(base, p.select(F.lit("turn").alias("hit_type"), F.col("turn_id").alias("hit_id"), "term", "rank"), n)
    return terms.select("term", "df", F.round("idf_weight", 9).alias("idf_weight"))


def _search(spark, sf, kind: str):
    turns, entries = _entries(spark, sf)
    q = spark.createDataFrame([(0, QUERY), (1, "next step what decided")], "query_id int, query string")
    hits = search.score_hits(q, turns, entries.filter("status = 'active'"), _attachments(spark, sf), limit=8, shorten=False, kinds=(kind,))
    return hits.select("query_id", "hit_id", F.round("score", 9).alias("score"))


def search_exact_turns(spark, sf):
    """Turn evidence for one literal query without entries or attachments; this is the flagship query."""
    q = spark.createDataFrame([(0, QUERY)], "query_id int, query string")
    hits = search.score_hits(q, _turns(spark, sf), _no_entries(spark), _no_attachments(spark), limit=8, shorten=False)
    return hits.select("query_id", "hit_id", F.round("score", 9).alias("score"))


def search_exact_entries(spark, sf):
    return _search(spark, sf, "entry")


def search_exact_attachments(spark, sf):
    q = spark.createDataFrame([(0, QUERY)], "query_id int, query string")
    hits = search.score_hits(q, _turns(spark, sf), _no_entries(spark), _attachments(spark, sf), limit=8, shorten=False)
    return hits.filter("hit_type = 'attachment'").select("query_id", "hit_id", F.round("score", 9).alias("score"))


def search_benchmark_batch(spark, sf):
    """Every benchmark item as a query, at once."""
    q = _read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.search(q, _turns(spark, sf), _no_entries(spark), _attachments(spark, sf)).select("query_id", "rank", "hit_type", "hit_id", F.round("score", 9).alias("score"))


def anchor_factors(spark, sf):
    a = strong_anchors(F.lit("The thonon reanti, of erinnd"))
    return _turns(spark, sf).select("turn_id", F.round(anchor_ratio(a, F.col("content")), 9).alias("ratio"), F.round(anchor_factor(a, F.col("content")), 9).alias("factor"))


def next_assistant_reply(spark, sf):
    return search.next_assistant(_turns(spark, sf))


def recent_turns(spark, sf):
    return resume.recent_turns(_turns(spark, sf), 10).select("turn_id", "role")


def latest_state(spark, sf):
    turns, entries = _entries(spark, sf)
    return resume.latest_state(entries, turns).select("kind", "hit_id", F.round("score", 9).alias("score"))


def _raw_hits(spark, sf):
    t = _turns(spark, sf)
    low = F.substring("content", 1, 12)
    return t.select(
        (F.col("turn_id") % 7).alias("query_id"),
        F.when(F.col("turn_id") % 2 == 0, "entry").otherwise("turn").alias("hit_type"),
        (F.col("turn_id") % 50).alias("hit_id"),
        F.upper("role").alias("kind"),
        low.alias("content"),
        F.col("turn_id").alias("source_turn_id"),
        (F.col("turn_id") * 37 % 101 / 101.0).alias("score"),
    )


def merge_hits(spark, sf):
    return search.merge_hits(_raw_hits(spark, sf), 8).select("query_id", "rank", "hit_type", "hit_id", F.round("score", 9).alias("score"))


def budget_prefix(spark, sf):
    return resume.budget_prefix(_turns(spark, sf), ["session_id"], [F.col("seq")], 200).select("session_id", "seq", "tokens", "running")


def jaccard_pairs(spark, sf):
    return search.near_pairs(_read(spark, sf, "documents").select("doc_id", normalize_text("text").alias("text")), "doc_id", "text").select("a", "b", F.round("similarity", 9).alias("similarity"))


def context_mode(spark, sf):
    m = resume.forwarded(_read(spark, sf, "conversations"), "auto", threshold=600, recent=1)
    return m.select("conv_id", "tokens", "replaced", "task", F.size("messages").alias("kept"))


def media_types(spark, sf):
    return spark.createDataFrame(FILES, "filename string, mime string").select("filename", media_type(F.col("mime"), F.col("filename")).alias("media_type"))


def attach_dedupe(spark, sf):
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt"))
    d = _read(spark, sf, "documents").select(name.alias("filename"), F.sha2("text", 256).alias("sha256"))
    one = artifacts.distinct_files(d)
    return one.select("sha256", F.substring("filename", 1, 12).cast("long").alias("attachment_id"), "copies")


def verify_hashes(spark, sf):
    t = _turns(spark, sf).withColumn("sha256", fingerprint(F.col("content")))
    bad = t.withColumn("content", F.when(F.col("turn_id") % 50 == 7, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return ingest.verify(bad)


def parse_transcript(spark, sf):
    c = _read(spark, sf, "conversations")
    line = F.concat(F.initcap("role"), F.lit(": "), "text")
    t = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("value"))
    return chat.from_transcript(t, "conv_id").select("conv_id", "pos", "role", "content")


def import_json(spark, sf):
    """The conversations as one JSON message list each, read back."""
    c = _read(spark, sf, "conversations")
    v = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("pos"), F.parse_json(F.to_json(F.struct(F.col("role").alias("author"), F.array("text", F.lit("tail")).alias("content"), F.col("conv_id").cast("string").alias("session_id")))).alias("v"))
    return chat.message_items(v).select("session_id", "pos", "role", "content")


def sketch_search(spark, sf):
    """Coarse scores through 512-bit sketches."""
    p = postings(_turns(spark, sf), ["turn_id"], "content", 64)
    s = sketches(p, ["turn_id"])
    base = query_features(spark.createDataFrame([(0, QUERY)], "query_id int, query string"), ["query_id"], "query")
    q = sketch_positions(base, b"")
    total = base.agg(F.sum("weight").alias("total"))
    # A term's first bit finds the sketches that may hold it; then all its bits are looked up.
    by_bit = s.select("turn_id", "sketch", F.explode("sketch").alias("bit"))
    met = by_bit.join(q.withColumn("bit", F.col("bits")[0]), "bit").filter(maybe_contains(F.col("sketch"), F.col("bits"))).join(F.broadcast(total))
    return met.groupBy("turn_id").agg(F.round(F.sum("weight") / F.first("total"), 9).alias("coarse"))


def dictionary_fold(spark, sf):
    return _entries(spark, sf)[1].select("entry_id", "kind", "content", "status", "version", "source_turn_id", "supersedes_id")


def resume_packet(spark, sf):
    turns, entries = _entries(spark, sf)
    packet = resume.resume(spark, "Continue: " + QUERY, turns, entries, _attachments(spark, sf))
    return spark.createDataFrame([(packet, resume.tokens_of(packet))], "packet string, estimated_tokens int")


def excerpts(spark, sf):
    turns = _turns(spark, sf).select("turn_id", F.lit(0).alias("query_id"), "content")
    q = spark.createDataFrame([(0, QUERY)], "query_id int, query string")
    return excerpt.excerpts(turns, ["turn_id"], q, 300).select("turn_id", "excerpt")


def export_markdown(spark, sf):
    t = _turns(spark, sf)
    return t.select("turn_id", markdown_turn().alias("line"))


_ALL = (
    turn_profile, normalized_messy, turn_dedupe, block_pack, role_tokens, session_stats, store_stats, sentence_split, question_flag, atom_kind_user,
    atom_kind_other, fact_candidates, atoms_topk, anchors, latin_terms, cjk_ngrams, features_topk, doc_freq, idf_query, search_exact_turns,
    search_exact_entries, search_exact_attachments, search_benchmark_batch, anchor_factors, next_assistant_reply, recent_turns, latest_state, merge_hits,
    budget_prefix, jaccard_pairs, context_mode, media_types, attach_dedupe, verify_hashes, parse_transcript, import_json, sketch_search,
    dictionary_fold, resume_packet, excerpts, export_markdown,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
