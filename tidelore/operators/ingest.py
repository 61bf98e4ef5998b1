"""Turn tables: normalisation, exact dedupe, numbering and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numbering import numbered
from ..functions.text import estimate_tokens, fingerprint, normalize_role, with_normalized

BLOCK_TURNS = 16


def number_turns(items: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Turns to add from items (session_id, pos, role, content, created_at, extract).

    Items whose (session, role, hash) exists already, here or earlier in the batch, are left out. Ids follow `pos` over all
    sessions, seq follows within each session.
    """
    items = with_normalized(items.withColumn("role", normalize_role(F.col("role"))), "content", "normalized").filter("normalized <> ''")
    items = items.withColumn("content", F.col("normalized")).drop("normalized").withColumn("sha256", fingerprint(F.col("content")))
    key = ["session_id", "role", "sha256"]
    new = items.withColumn("_copy", F.row_number().over(W.partitionBy(*key).orderBy("pos"))).filter("_copy = 1").drop("_copy")
    first_id = 0
    if existing is not None:
        new = new.join(existing.select(*key), key, "left_anti")
        first_id = existing.agg(F.max("turn_id")).first()[0] or 0
        seqs = existing.groupBy("session_id").agg(F.max("seq").alias("_seq"))
        new = new.join(seqs, "session_id", "left")
    else:
        new = new.withColumn("_seq", F.lit(0))
    return numbered(new, ["pos"], "turn_id", first_id).select(
        "turn_id",
        "session_id",
        (F.coalesce("_seq", F.lit(0)) + F.row_number().over(W.partitionBy("session_id").orderBy("pos"))).cast("long").alias("seq"),
        "role",
        "content",
        "created_at",
        F.octet_length("content").cast("long").alias("raw_bytes"),
        estimate_tokens(F.col("content")).alias("estimated_tokens"),
        "sha256",
        "extract",
    )


def blocks(turns: DataFrame, cap: int = BLOCK_TURNS) -> DataFrame:
    """One row per block of at most `cap` turns of a session: its range, size and the hash of its JSON."""
    t = turns.withColumn("block", F.floor((F.row_number().over(W.partitionBy("session_id").orderBy("seq")) - 1) / max(1, cap)))
    rows = t.groupBy("session_id", "block").agg(
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.min("turn_id").alias("first_turn_id"),
        F.max("turn_id").alias("last_turn_id"),
        F.count("*").alias("turn_count"),
        F.sum("raw_bytes").alias("text_bytes"),
        F.to_json(F.array_sort(F.collect_list(F.struct("seq", "turn_id", "role", "content", "created_at")))).alias("payload"),
    )
    return rows.withColumn("sha256", F.sha2("payload", 256))


def verify(turns: DataFrame) -> DataFrame:
    """Turns whose stored hash is not the hash of their content."""
    return turns.filter(~F.col("sha256").eqNullSafe(fingerprint(F.col("content")))).select("turn_id", F.concat(F.lit("turn "), F.col("turn_id"), F.lit(": hash mismatch")).alias("problem"))


def stats(turns: DataFrame, entries: DataFrame, attachments: DataFrame) -> DataFrame:
    """Counts, sizes and ratios of one store in a row; ratios are 0 where there is nothing to divide by."""
    t = turns.agg(F.count("*").alias("turns"), F.countDistinct("session_id").alias("sessions"), F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_message_bytes"), F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("estimated_raw_tokens"))
    b = blocks(turns).agg(F.count("*").alias("raw_blocks"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("block_json_raw_bytes"))
    live = F.col("status") == "active"
    cjk = F.length(F.regexp_replace("content", "[^㐀-鿿]", ""))
    e = entries.agg(
        F.count("*").alias("all_entries"),
        F.count_if(live).alias("active_entries"),
        F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("entry_text_bytes"),
        F.coalesce(F.sum(F.when(live, cjk)), F.lit(0)).alias("_cjk"),
        F.coalesce(F.sum(F.when(live, F.length("content"))), F.lit(0)).alias("_chars"),
    )
    a = attachments.agg(F.count("*").alias("attachments"), F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("attachment_raw_bytes"))
    # Four one-row frames side by side.
    row = t.crossJoin(b).crossJoin(e).crossJoin(a)
    joined = F.col("_chars") + F.greatest(F.lit(0), F.col("active_entries") - 1)
    return row.withColumn("estimated_dictionary_tokens", F.greatest(F.lit(1), F.col("_cjk") + F.ceil((joined - F.col("_cjk")) / 4))).withColumn(
        "payload_ratio", F.coalesce(F.try_divide(F.col("block_json_raw_bytes"), F.col("raw_message_bytes")), F.lit(0.0))
    ).withColumn("index_records", F.col("turns") + F.col("all_entries") + F.col("attachments")).drop("_cjk", "_chars")
