"""Helpers that all operators share: durable intermediates and text buckets."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that one bucket (the unit a Python worker holds at once) aims at.
BUCKET_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local one only where none is named (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="tidelore-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet below the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and every later
    reader sees the same rows in the same files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelore/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts, at least 1 (one aggregate over the text column)."""
    return max(1, docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


def bucketed(docs: DataFrame, id_col: str, text_col: str, n_buckets: int, *extra: str) -> DataFrame:
    """(bkt, doc_id, text): rows dealt by a hash of id and text, so a repeated or null id does not gather."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_buckets)).cast("int").alias("bkt"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in extra],
    )


def buckets_for(total_bytes: int, per: int = BUCKET_BYTES) -> int:
    return max(1, math.ceil(total_bytes / per))


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the offset of each row (one more than rows)."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.large_string())
    arr = arr.cast(pa.large_binary())
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64, len(arr) + 1, arr.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
