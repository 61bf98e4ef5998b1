"""Token counts of flat token files by a separator scan.

A flat file is a run of token ids, each document followed by the end-of-document id, and has no index. Blocks of
a fixed number of ids, cut without regard to documents, are searched for the separator on their own; a prefix
scan over one small row per block then carries the open document and the number of documents over the cuts.

Cases: null and empty texts are documents of 0 tokens; a document may span any number of blocks; ids after a
file's last separator are an unterminated document; repeated rows and ids stay documents of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import materialize
from .packing import token_ids, vocabulary

END_OF_DOCUMENT = 50256
BLOCK_IDS = 1 << 16
DTYPE = "<u2"


def write_flat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_OF_DOCUMENT, block_ids: int = BLOCK_IDS, vocab: tuple[str, str] | None = None) -> DataFrame:
    """Stored token blocks (file, block, ids) of all documents, one file per task, and beside them the files' lists
    of document ids in order (file, part, docs): one table, a row is either."""
    from pyspark import TaskContext

    path, pattern = vocab or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, part = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        size = 0

        def row(block: int | None, ids: bytes | None, part: int | None, docs: pa.Array | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "block": pa.array([block], pa.int32()), "ids": pa.array([ids], pa.binary()), "part": pa.array([part], pa.int32()), "docs": pa.array([docs], pa.list_(pa.int64()))})

        for batch in batches:
            if not batch.num_rows:
                continue
            yield row(None, None, part, batch["doc_id"].to_pylist())
            part += 1
            for text in batch["text"]:
                ids = token_ids(text.as_py(), path, pattern, False).astype(DTYPE)
                held += [ids, np.array([end_id], DTYPE)]
                size += len(ids) + 1
                if size >= block_ids:
                    run_ = np.concatenate(held)
                    cut = size - size % block_ids
                    for a in range(0, cut, block_ids):
                        yield row(block, run_[a : a + block_ids].tobytes(), None, None)
                        block += 1
                    held, size = [run_[cut:]], size - cut
        if size:
            yield row(block, np.concatenate(held).tobytes(), None, None)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialize(texts.mapInArrow(run, "file int, block int, ids binary, part int, docs array<long>"), "flat")


def read_flat(spark: SparkSession, path: str, id_bytes: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks (file, block, ids) of flat binary token files that any Spark file system holds."""
    size = block_ids * id_bytes
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", "length")
    starts = F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size).cast("int"))
    return files.filter("length > 0").select("file", "content", F.explode(starts).alias("block")).select("file", "block", F.substring(F.col("content"), F.col("block") * size + 1, F.lit(size)).alias("ids"))


def scan_separators(blocks: DataFrame, end_id: int = END_OF_DOCUMENT, dtype: str = DTYPE) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) of every document of the files of `blocks` (file, block, ids)."""
    kind = blocks.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, block, raw in zip(pdf["file"], pdf["block"], pdf["ids"]):
                ids = np.frombuffer(raw, dtype)
                out.append((file, block, len(ids), np.flatnonzero(ids == end_id)))
            yield pd.DataFrame(out, columns=["file", "block", "n", "ends"])

    found = blocks.select("file", "block", "ids").mapInPandas(run, f"file {kind}, block int, n long, ends array<long>")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    scanned = (
        found.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("ordinal0", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
        .withColumn("ends", F.transform("ends", lambda e: e + F.col("base")))
        .withColumn("open", F.coalesce(F.max(F.try_element_at("ends", F.lit(-1)) + 1).over(before), F.lit(0)))
        .withColumn("last", F.lead("block").over(W.partitionBy("file").orderBy("block")).isNull())
    )
    # A document starts where the one before it ended; the first of a block where the scan says.
    starts = F.concat(F.array("open"), F.transform("ends", lambda e: e + 1))
    stop = F.col("base") + F.col("n")
    tail = F.col("last") & (F.element_at(starts, -1) < stop)
    ends = F.when(tail, F.concat("ends", F.array(stop))).otherwise(F.col("ends"))
    pairs = scanned.select("file", "ordinal0", F.size("ends").alias("closed"), F.posexplode(F.arrays_zip(F.slice(starts, 1, F.size(ends)).alias("start"), ends.alias("end"))).alias("k", "d"))
    return pairs.select("file", (F.col("ordinal0") + F.col("k")).alias("ordinal"), F.col("d.start").alias("start"), (F.col("d.end") - F.col("d.start")).alias("n_tokens"), (F.col("k") < F.col("closed")).alias("terminated"))


def count_documents(flat: DataFrame, end_id: int = END_OF_DOCUMENT) -> DataFrame:
    """(doc_id, file, start, n_tokens) of every document of a table from write_flat."""
    found = scan_separators(flat.filter("ids is not null"), end_id)
    lists = flat.filter("docs is not null").select("file", "part", "docs")
    before = W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    named = lists.withColumn("base", F.coalesce(F.sum(F.size("docs")).over(before), F.lit(0))).select("file", "base", F.posexplode("docs").alias("k", "doc_id"))
    named = named.select("file", (F.col("base") + F.col("k")).alias("ordinal"), "doc_id")
    return found.join(named, ["file", "ordinal"]).select("doc_id", "file", "start", "n_tokens")
