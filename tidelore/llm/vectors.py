"""Vectors in packed blocks, and exact top-k over pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK_ROWS = 2048
PACKED = "ids binary, data binary, dim int"


def usable(vectors: DataFrame, id_col: str, vec_col: str, nonzero: bool, distinct: bool = True) -> DataFrame:
    """(vec_id, v): rows with an id and only finite components, doubles; if `distinct`, of rows that repeat an id the least vector."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ok = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad
    if nonzero:
        ok &= F.exists(v, lambda x: x != 0)
    rows = vectors.filter(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")) if distinct else rows


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    arr = column.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(arr), -1).astype(np.float64)


def pack(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (vec_id, v, sorted or not) of each partition in blocks: part, blk, n, ids, data, dim. Vectors of one length per block."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blk = TaskContext.get().partitionId(), 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            dims = pa.compute.list_value_length(t["v"]).to_numpy()
            for dim in np.unique(dims):
                own = t.filter(pa.array(dims == dim))
                for a in range(0, own.num_rows, block_rows):
                    cut = own.slice(a, block_rows)
                    ids = cut["vec_id"].to_numpy().astype("<i8")
                    data = matrix(cut["v"]).astype("<f8")
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "blk": pa.array([blk], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary()), "dim": pa.array([int(dim)], pa.int32())})
                    blk += 1

    return rows.mapInArrow(run, f"part int, blk int, n int, {PACKED}")


def unpack(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, "<f8").reshape(-1, dim)


def merge_best(hits: DataFrame, k: int, distinct: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best hits of each query, ties to the smaller id; if `distinct`, a vec_id counts once.

    Sorts per query what blocks have kept, k rows each.
    """
    from pyspark.sql import Window as W

    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")) if distinct else hits
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
