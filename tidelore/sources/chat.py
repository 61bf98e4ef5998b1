"""Importers: JSON lines, JSON documents and loose transcripts, as item tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import normalize_role, strip

_ROLE = "user|human|assistant|ai|chatgpt|claude|system|tool"
HEADING = rf"(?i)^\s{{0,3}}(?:#{{1,6}}\s*)?({_ROLE})\s*[:：]?\s*$"
PREFIX = rf"(?i)^\s{{0,3}}(?:#{{1,6}}\s*)?({_ROLE})\s*[:：]\s*(.*)$"
ITEM = "session_id string, pos bigint, role string, content string, created_at string, extract boolean"


def _text(v: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(v, f"$.{path}", "string"), F.lit(""))


def _content(v: Column, names: tuple[str, ...] = ("content", "text", "message")) -> Column:
    """The first of some fields that is there: a string, or a list of parts that newlines join."""

    def one(path: str) -> Column:
        parts = F.try_variant_get(v, f"$.{path}", "array<variant>")
        part = lambda p: F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")).otherwise(F.coalesce(_text(p, "text"), _text(p, "content")))
        joined = F.array_join(F.filter(F.transform(parts, part), lambda s: s.isNotNull()), "\n")
        return F.nullif(F.coalesce(joined, F.try_variant_get(v, f"$.{path}", "string")), F.lit(""))

    return F.coalesce(*[one(n) for n in names])


#: Fields that stand for role, content and time in a JSON document, and in a JSON line.
DOCUMENT = (("role", "author", "speaker"), ("content", "text", "message"), ("created_at", "timestamp"))
LINE = (("role",), ("content", "text"), ("created_at",))


def message_items(messages: DataFrame, session_id: str = "main", fields: tuple = DOCUMENT) -> DataFrame:
    """Items of (pos, v): one variant per message. A message without role or content is an error."""
    m = messages.select("pos", F.col("v"))
    roles, contents, times = fields
    role = F.coalesce(*[_text(F.col("v"), n) for n in roles])
    content = _content(F.col("v"), contents)
    bad = F.raise_error(F.concat(F.lit("message "), F.col("pos"), F.lit(" requires role and content")))
    return m.select(
        F.coalesce(_text(F.col("v"), "session_id"), F.lit(session_id)).alias("session_id"),
        F.col("pos").cast("long").alias("pos"),
        F.when(role.isNull() | content.isNull(), bad).otherwise(normalize_role(role)).alias("role"),
        content.alias("content"),
        F.coalesce(*[_text(F.col("v"), n) for n in times]).alias("created_at"),
        F.coalesce(F.try_variant_get(F.col("v"), "$.extract", "boolean"), F.lit(True)).alias("extract"),
    )


def from_jsonl(lines: DataFrame, session_id: str = "main") -> DataFrame:
    """Items of (pos, value): one JSON object per line; blank lines are skipped, bad ones are errors with their place."""
    full = lines.filter(strip(F.col("value")) != "")
    v = F.try_parse_json("value")
    bad = F.raise_error(F.concat(F.lit("invalid JSON at line "), F.col("pos"))).cast("string")
    return message_items(full.withColumn("v", F.parse_json(F.coalesce(F.when(v.isNotNull(), F.col("value")), bad))), session_id, LINE)


def from_json(text: DataFrame, session_id: str = "main") -> DataFrame:
    """Items of (value): JSON lists of messages or objects that hold them."""
    v = text.select(F.parse_json("value").alias("d"))
    items = F.coalesce(F.try_variant_get("d", "$.messages", "array<variant>"), F.try_variant_get("d", "$", "array<variant>"))
    return message_items(v.select(F.posexplode(items).alias("pos", "v")).withColumn("pos", F.col("pos") + 1), session_id)


def from_transcript(texts: DataFrame, key: str, text: str = "value", default_role: str = "user") -> DataFrame:
    """Turns (key, pos, role, content) of loose transcripts: `Role: text` lines or role headings start a turn."""
    lines = texts.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("line", "s"))
    heading, prefix = F.col("s").rlike(HEADING), F.col("s").rlike(PREFIX)
    lines = lines.withColumn("role", F.when(heading, F.regexp_extract("s", HEADING, 1)).when(prefix, F.regexp_extract("s", PREFIX, 1)))
    lines = lines.withColumn("s", F.when(heading, F.lit(None)).when(prefix, F.nullif(F.regexp_extract("s", PREFIX, 2), F.lit(""))).otherwise(F.col("s")))
    turn = F.sum(F.col("role").isNotNull().cast("int")).over(W.partitionBy(key).orderBy("line"))
    grouped = lines.withColumn("turn", turn).groupBy(key, "turn").agg(F.max("role").alias("role"), F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("line", "s")))).alias("body"))
    content = strip(F.array_join(F.transform("body", lambda b: b["s"]), "\n"))
    return grouped.select(key, F.col("turn").alias("pos"), normalize_role(F.coalesce("role", F.lit(default_role))).alias("role"), content.alias("content")).filter("content <> ''")


def read_chat(spark: SparkSession, path: str, input_format: str = "auto", default_role: str = "user", session_id: str = "main") -> DataFrame:
    """Items of a chat file."""
    return from_text(spark.read.text(path, wholetext=True), input_format, default_role, session_id)


def from_text(whole: DataFrame, input_format: str = "auto", default_role: str = "user", session_id: str = "main") -> DataFrame:
    """Items of whole texts (value). `auto` looks at the first characters: a JSON document, JSON lines, else a transcript."""
    kind = {"md": "markdown", "text": "markdown", "txt": "markdown"}.get(input_format, input_format)
    if kind == "auto":
        head = (whole.select(F.substring(F.ltrim("value"), 1, 1).alias("c"), F.try_parse_json("value").isNotNull().alias("j")).first()) or {"c": "", "j": False}
        kind = "json" if head["c"] in ("[", "{") and head["j"] else "jsonl" if head["c"] == "{" else "markdown"
    if kind == "json":
        return from_json(whole, session_id)
    if kind == "jsonl":
        return from_jsonl(whole.select(F.posexplode(F.split("value", "\n")).alias("pos", "value")).withColumn("pos", F.col("pos") + 1), session_id)
    t = from_transcript(whole.withColumn("file", F.lit(0)), "file", "value", default_role)
    return t.select(F.lit(session_id).alias("session_id"), F.col("pos").cast("long").alias("pos"), "role", "content", F.lit(None).cast("string").alias("created_at"), F.lit(True).alias("extract"))


def message_text(content: object) -> str:
    """The visible text of one message's content: a string, or a list of strings and text parts."""
    if content is None:
        return ""
    if not isinstance(content, list):
        return content if isinstance(content, str) else str(content)
    found = []
    for part in content:
        text = part
        if isinstance(part, dict):
            text = part.get("text") if isinstance(part.get("text"), str) else part.get("content") if part.get("type") == "text" else None
        if isinstance(text, str):
            found.append(text)
    return "\n".join(found)


def response_text(payload: object) -> str:
    """The text of the first choice of a chat completion, or an empty string."""
    choices = payload.get("choices") if isinstance(payload, dict) else None
    first = choices[0] if isinstance(choices, list) and choices and isinstance(choices[0], dict) else {}
    message = first.get("message")
    return message_text((message.get("content") if isinstance(message, dict) else None) or first.get("text"))
