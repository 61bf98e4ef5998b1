"""Approximate nearest neighbours by shifted Hilbert curves.

Each of several curves projects the unit vectors by its own random orthonormal directions, shifts them,
and orders all rows by their place on a Hilbert curve; Spark range-partitions each order, and the rows
of a range are stored in blocks. A query takes as candidates the blocks within a window around its own on every
curve; candidates of all curves are merged and reranked by exact cosine in double precision.

The window (blocks on each side) is fitted: for at most SAMPLE queries the true neighbours are found by brute
force, and the window is the least that reaches TARGET of them on some curve. Every row is indexed. Vectors
without any low-dimensional structure need wide windows; the fit then says so instead of losing recall.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of another
length than the query's are no candidates of it; rows that repeat an id count once, with the least vector; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialize
from .segments import grid
from .vectors import BLOCK_ROWS, matrix, merge_best, pack, unpack, usable

CURVES = 4
DIMS = 4
BITS = 12
SAMPLE = 96
TARGET = 0.97
#: Query packs that meet one stored block in one row.
PACKS = 64
HITS = "query_id long, vec_id long, score double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each integer point (row, dims) on the Hilbert curve of 2**bits cells a side (Skilling's transform)."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > 1:
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_keys(data: np.ndarray, curve: int) -> np.ndarray:
    """Keys of rows on one curve. Coordinates are scaled by what isotropic unit vectors have, and squashed into (0, 1)."""
    dim = data.shape[1]
    rng = np.random.default_rng([curve, dim])
    axes, _ = np.linalg.qr(rng.standard_normal((dim, min(DIMS, dim))))
    unit = data / np.sqrt((data * data).sum(axis=1, keepdims=True))
    place = 1 / (1 + np.exp(-1.7 * (unit @ axes) * math.sqrt(dim)))
    place = (place + rng.random(axes.shape[1])) / 2
    return hilbert_keys(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def cosine_best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, cosines): the k nearest of the block; equal vectors get equal scores, wherever they stand."""
    nq, nx = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    rough = (q / nq[:, None]) @ (x / nx[:, None]).T
    for r, own in enumerate(q_ids.tolist()):
        sims = np.where(ids == own, -np.inf, rough[r])
        kth = np.partition(sims, len(sims) - k)[len(sims) - k] if len(sims) > k else -2.0
        near = np.flatnonzero(sims >= max(kth, -2.0) - 1e-9)
        exact = (x[near] * q[r]).sum(axis=1) / (nq[r] * nx[near])
        top = np.lexsort((ids[near], -exact))[:k]
        yield own, ids[near[top]], exact[top]


def _hits(found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    out = [(np.full(len(i), own), i, s) for own, i, s in found]
    a, b, c = (np.concatenate(z) for z in zip(*out)) if out else ([], [], [])
    return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})


def brute_force(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact neighbours of `queries` among `vectors` (both vec_id, v), block by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                yield _hits(cosine_best(*unpack(r.q_ids, r.q_data, r.q_dim), *unpack(r.ids, r.data, r.dim), k))

    q, b = materialize(pack(queries.coalesce(1)), "sample"), materialize(pack(vectors), "blocks")
    return merge_best(grid(q, b).mapInPandas(run, HITS), k)


def ordered_blocks(rows: DataFrame, curves: int, block_rows: int) -> DataFrame:
    """Stored blocks of every curve's order: curve, j (place of the block), n, ids, data, dim."""
    from pyspark import TaskContext

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            dims = pa.compute.list_value_length(t["v"]).to_numpy()
            for dim in np.unique(dims):
                own = t.filter(pa.array(dims == dim))
                data = matrix(own["v"])
                for c in range(curves):
                    out = own.append_column("curve", pa.array(np.full(len(data), c), pa.int32())).append_column("key", pa.array(curve_keys(data, c), pa.int64()))
                    yield from out.append_column("dim", pa.array(np.full(len(data), dim), pa.int32())).combine_chunks().to_batches()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blk = TaskContext.get().partitionId(), 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            group = t["dim"].to_numpy().astype(np.int64) << 32 | t["curve"].to_numpy()
            edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            for s, e in zip(edges[:-1], edges[1:]):
                for a in range(s, e, block_rows):
                    own = t.slice(a, min(block_rows, e - a))
                    ids, data = own["vec_id"].to_numpy().astype("<i8"), matrix(own["v"]).astype("<f8")
                    yield pa.RecordBatch.from_pydict({"curve": pa.array([own["curve"][0].as_py()], pa.int32()), "part": pa.array([part], pa.int32()), "blk": pa.array([blk], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary()), "dim": pa.array([own["dim"][0].as_py()], pa.int32())})
                    blk += 1

    keyed = rows.mapInArrow(keys, "vec_id long, v array<double>, curve int, key long, dim int")
    parts = max(1, math.ceil(rows.count() * curves / (4 * block_rows)))
    # The id in the range key lets equal vectors, whose keys are equal, spread over ranges.
    dealt = keyed.repartitionByRange(parts, "dim", "curve", "key", "vec_id").sortWithinPartitions("dim", "curve", "key", "vec_id")
    stored = materialize(dealt.mapInArrow(cut, "curve int, part int, blk int, n int, ids binary, data binary, dim int"), "curves")
    place = stored.select("curve", "part", "blk", "dim").withColumn("j", F.row_number().over(W.partitionBy("curve", "dim").orderBy("part", "blk"))).drop("dim")
    return materialize(stored.join(place, ["curve", "part", "blk"]).drop("part", "blk"), "ordered")


def query_packs(blocks: DataFrame, every: int) -> DataFrame:
    """(curve, dim, home, q_ids, q_data): the queries of each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                ids, x = unpack(r.ids, r.data, r.dim)
                own = ids % every == 0
                if own.any():
                    out.append((r.curve, r.dim, r.j, ids[own].tobytes(), x[own].tobytes()))
            yield pd.DataFrame(out, columns=["curve", "dim", "home", "q_ids", "q_data"])

    return blocks.select("curve", "dim", "j", "ids", "data").mapInPandas(run, "curve int, dim int, home int, q_ids binary, q_data binary")


def fitted_window(rows: DataFrame, blocks: DataFrame, every: int, k: int, sample: int, target: float) -> int:
    """The least window that reaches `target` of the sampled queries' true neighbours; all sizes are bounded by `sample`."""
    chosen = rows.filter(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    true = [(r["query_id"], r["vec_id"]) for r in brute_force(materialize(chosen, "chosen"), rows, k).collect()]
    if not true:
        return 0
    wanted = np.unique(np.array(true))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for curve, j, raw in zip(pdf["curve"], pdf["j"], pdf["ids"]):
                own = np.intersect1d(np.frombuffer(raw, "<i8"), wanted)
                yield pd.DataFrame({"curve": curve, "j": j, "vec_id": own})

    at: dict[int, dict[int, int]] = {}
    for r in blocks.select("curve", "j", "ids").mapInPandas(places, "curve int, j int, vec_id long").collect():
        at.setdefault(r["vec_id"], {})[r["curve"]] = r["j"]
    apart = sorted(min(abs(at[q][c] - at[v][c]) for c in at[q]) for q, v in true)
    return apart[math.ceil(target * len(apart)) - 1]


def nearest(vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = CURVES, block_rows: int = BLOCK_ROWS, window: int | None = None, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for every row whose id `every` divides."""
    rows = materialize(usable(vectors, id_col, vec_col, nonzero=True), "vectors")
    blocks = ordered_blocks(rows, curves, block_rows)
    w = fitted_window(rows, blocks, every, k, sample, target) if window is None else window
    packs = query_packs(blocks, every).withColumn("j", F.explode(F.sequence(F.greatest(F.lit(1), F.col("home") - w), F.col("home") + w)))
    gathered = packs.groupBy("curve", "dim", "j", (F.col("home") % math.ceil((2 * w + 1) / PACKS)).alias("salt")).agg(F.collect_list(F.struct("q_ids", "q_data")).alias("packs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                q_ids = np.frombuffer(b"".join(p["q_ids"] for p in r.packs), "<i8")
                q = np.frombuffer(b"".join(p["q_data"] for p in r.packs), "<f8").reshape(-1, r.dim)
                yield _hits(cosine_best(q_ids, q, *unpack(r.ids, r.data, r.dim), k))

    met = gathered.join(blocks.select("curve", "dim", "j", "ids", "data"), ["curve", "dim", "j"])
    return merge_best(met.select("packs", "ids", "data", "dim").mapInPandas(run, HITS), k)
