"""File artifacts: reading, media types, sidecar texts and dedupe by content."""

from __future__ import annotations

import mimetypes
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.numbering import numbered
from ..functions.text import media_type, with_normalized

TEXT_BYTES, TEXT_CHARS = 200_000, 5000


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, mime_type, media_type, raw_bytes, sha256, payload) of all files that `path` names."""
    def mime(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in names:
            yield s.map(lambda n: mimetypes.guess_type(n)[0] or "application/octet-stream")

    f = spark.read.format("binaryFile").load(path).withColumn("filename", F.element_at(F.split("path", "/"), -1))
    f = f.withColumn("mime_type", F.pandas_udf(mime, "string")("filename"))
    return f.select("filename", "mime_type", media_type(F.col("mime_type"), F.col("filename")).alias("media_type"), F.col("length").alias("raw_bytes"), F.sha2("content", 256).alias("sha256"), F.col("content").alias("payload"))


def _decoded(raw: bytes) -> str:
    for enc in ("utf-8", "utf-16", "latin-1"):
        try:
            return raw.decode(enc)
        except UnicodeError:
            continue
    return ""


def with_sidecars(files: DataFrame) -> DataFrame:
    """Adds sidecar_text: a text's beginning, or a line about the file where no reader for its kind is installed."""

    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda b: None if b is None else _decoded(bytes(b)))

    head = F.when(F.col("media_type") == "text", F.substring("payload", 1, TEXT_BYTES))
    f = with_normalized(files.withColumn("_t", F.pandas_udf(decode, "string")(head)), "_t", "_n")
    note = F.concat(F.when(F.col("media_type") == "image", "Image ").when(F.col("media_type") == "pdf", "PDF ").otherwise("Attachment "), "filename")
    tail = F.when(F.col("media_type") == "image", ": metadata extraction unavailable.").when(F.col("media_type") == "pdf", ": text extraction unavailable.").otherwise(F.concat(F.lit(": "), "media_type", F.lit(", "), "raw_bytes", F.lit(" bytes.")))
    return f.withColumn("sidecar_text", F.when(F.col("media_type") == "text", F.substring("_n", 1, TEXT_CHARS)).otherwise(F.concat(note, tail))).drop("_t", "_n")


def distinct_files(files: DataFrame) -> DataFrame:
    """One row per content (sha256), the first by name, and how many copies there are."""
    same = W.partitionBy("sha256")
    first = files.withColumn("copies", F.count("*").over(same)).withColumn("_n", F.row_number().over(same.orderBy("filename")))
    return first.filter("_n = 1").drop("_n")


def attach(files: DataFrame, existing: DataFrame | None = None, source_turn_id: int | None = None) -> DataFrame:
    """New attachment rows: one per content that is not stored yet, numbered after the stored ones."""
    first = 0
    if existing is not None:
        first = existing.agg(F.max("attachment_id")).first()[0] or 0
        files = files.join(existing.select("sha256"), "sha256", "left_anti")
    return with_sidecars(numbered(distinct_files(files), ["filename", "sha256"], "attachment_id", first)).select(
        "attachment_id",
        "filename", "mime_type", "media_type", "raw_bytes", "sha256", "sidecar_text", F.lit(source_turn_id).cast("long").alias("source_turn_id"), "payload",
    )


def artifact_atoms(attachments: DataFrame) -> DataFrame:
    """An ARTIFACT atom per attachment, with at most 700 characters of its sidecar."""
    text = F.substring(F.concat(F.lit("Attachment "), "filename", F.lit(": "), "sidecar_text"), 1, 700)
    return attachments.select(F.coalesce("source_turn_id", F.lit(0).cast("long")).alias("turn_id"), F.lit("system").alias("role"), F.col("attachment_id").cast("int").alias("rank"), F.lit("ARTIFACT").alias("kind"), text.alias("content"), F.lit(0.9).alias("confidence"))


def restore(attachments: DataFrame, attachment_id: int, output: str) -> int:
    """Writes one payload to a local file on the driver after checking its hash; returns its size."""
    row = attachments.filter(F.col("attachment_id") == attachment_id).select("payload", "sha256", F.sha2("payload", 256).alias("now")).first()
    if row is None:
        raise KeyError(f"no attachment {attachment_id}")
    if row["sha256"] != row["now"]:
        raise ValueError(f"attachment {attachment_id}: hash mismatch")
    os.makedirs(os.path.dirname(os.path.abspath(output)), exist_ok=True)
    with open(output, "wb") as f:
        return f.write(bytes(row["payload"]))
