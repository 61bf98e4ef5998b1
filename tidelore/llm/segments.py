"""Exact top-k by multi-resolution segment statistics.

Vectors are cut into a few segments, then into more. Means and deviations of the segments bound the inner
product from above (Cauchy-Schwarz within each segment), hence the distance from below, as
|q - x|^2 = |q|^2 + |x|^2 - 2 q.x. A block of candidates is sifted coarse to fine against the k-th best exact
score so far, and only survivors get exact products. Query blocks meet candidate blocks on a grid of pairs, so
no task holds more than one block of each side.

Cases: vectors that are null, empty or hold null or non-finite components take no part; vectors of another
length than the query's are no candidates of it; rows that repeat an id are candidates of their own, and queries
that repeat an id share one list, the k best of all their products; products beyond a long are clipped to it; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialize
from .vectors import BLOCK_ROWS, merge_best, pack, unpack, usable

LEVELS = (4, 16)
FIRST = 256
HITS = "query_id long, vec_id long, score long"
LONG = np.iinfo(np.int64)


def quantized(data: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256.0 * data), -1e300, 1e300)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each scaled by the root of the segment's length."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    size = np.diff(edges).astype(float)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    rest = x - np.repeat(mean, np.diff(edges), axis=1)
    dev = np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1) / size)
    return np.concatenate([mean * np.sqrt(size), dev * np.sqrt(size)], axis=1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of one query with rows."""
    if not x.size or np.abs(q).max() * np.abs(x).max() * len(q) < 2.0**53:
        return (x @ q).astype(np.int64)
    big = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in x]
    return np.array([min(max(v, LONG.min), LONG.max) for v in big], np.int64)


def best_of_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores): the k best candidates of the block for each query, its own id left out."""
    coarse_to_fine = [(statistics(q, n), statistics(x, n)) for n in LEVELS]
    size = np.sqrt((x * x).sum(axis=1))
    for r, own in enumerate(q_ids.tolist()):
        slack = 1e-9 * math.sqrt(float(q[r] @ q[r])) * size + 1e-6
        near = np.arange(min(FIRST, len(ids)))
        near = near[ids[near] != own]
        score = products(q[r], x[near])
        left = np.arange(FIRST, len(ids))
        if len(near) >= k and len(left):
            kth = np.partition(score, len(score) - k)[len(score) - k]
            for fq, fx in coarse_to_fine:
                left = left[fx[left] @ fq[r] + slack[left] >= kth]
        left = left[ids[left] != own]
        near, score = np.concatenate([near, left]), np.concatenate([score, products(q[r], x[left])])
        top = np.lexsort((ids[near], -score.astype(object) if len(score) and score.min() == LONG.min else -score))[:k]
        yield own, ids[near[top]], score[top]


def grid(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every pair of a query block and a candidate block of the same length, one row each."""
    number = lambda t, c: t.join(t.select("part", "blk").withColumn(c, F.row_number().over(W.orderBy("part", "blk")) - 1), ["part", "blk"])
    nq, nd = queries.count(), blocks.count()
    spread = lambda t, c, n: t.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if not nq or not nd:
        nq = nd = 1
    q = spread(number(queries, "qi"), "di", nd).select("qi", "di", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("dim").alias("q_dim"))
    d = spread(number(blocks, "di"), "qi", nq).select("qi", "di", "ids", "data", "dim")
    return q.join(d, ["qi", "di"]).filter(F.col("q_dim") == F.col("dim"))


def blocks_of(vectors: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """Stored blocks of the queries (ids divisible by `every`) and of all rows of a stored table (vec_id, v)."""
    mine = vectors.filter(F.col("vec_id") % every == 0)
    full = max(1, math.ceil(mine.count() / BLOCK_ROWS))
    return materialize(pack(mine.repartition(full)), "queries"), materialize(pack(vectors), "blocks")


def top_products(vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) by the integer inner product of floor(256 x)."""
    rows = materialize(usable(vectors, id_col, vec_col, nonzero=False, distinct=False), "vectors")
    queries, blocks = blocks_of(rows, every)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                q_ids, q = unpack(row.q_ids, row.q_data, row.q_dim)
                ids, x = unpack(row.ids, row.data, row.dim)
                out = [(np.full(len(i), own), i, s) for own, i, s in best_of_block(q_ids, quantized(q), ids, quantized(x), k)]
                if out:
                    a, b, c = (np.concatenate(z) for z in zip(*out))
                    yield pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    return merge_best(grid(queries, blocks).mapInPandas(run, HITS), k, distinct=False)
