"""Packed exchange of keys between text buckets.

A bucket sends each of its distinct 48-bit keys once, packed into binary cells, one per range of keys;
each range then tells every bucket which of its keys other buckets also hold. A key that sits in a third
of all documents thus travels once per bucket, not once per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text whose keys one range task sorts.
RANGE_BYTES = 48 << 20
#: A key in more buckets than this is "wide".
WIDE_BUCKETS = 64
KEY_MASK = np.uint64((1 << 48) - 1)
WIDE_BIT = np.uint64(1 << 48)
CELLS = pa.schema([("rng", pa.int32()), ("bkt", pa.int32()), ("cell", pa.binary())])
ANSWERS = pa.schema([("bkt", pa.int32()), ("rng", pa.int32()), ("cell", pa.binary())])


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Keys ascend with their range."""
    return ((keys >> np.uint64(24)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def pack6(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack6(cell: bytes) -> np.ndarray:
    raw = np.frombuffer(cell, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel().astype(np.uint64)


def cells(keys: np.ndarray, bkt: int, ranges: int) -> pa.Table:
    """Rows of CELLS for the distinct keys of a bucket."""
    keys = np.unique(keys)
    edges = np.searchsorted(range_of(keys, ranges), np.arange(ranges + 1))
    used = np.flatnonzero(np.diff(edges))
    return pa.table([pa.array(used, pa.int32()), pa.array(np.full(len(used), bkt), pa.int32()), pa.array([pack6(keys[edges[r] : edges[r + 1]]) for r in used], pa.binary())], schema=CELLS)


def shared_keys(sent: DataFrame, wide_buckets: int = WIDE_BUCKETS) -> DataFrame:
    """(bkt, rng, cell): the keys of each bucket that another bucket holds too, as uint64 with WIDE_BIT set on wide ones."""

    def run(t: pa.Table) -> pa.Table:
        bkts = t["bkt"].to_numpy()
        parts = [unpack6(c.as_py()) for c in t["cell"]]
        keys = np.concatenate(parts)
        owner = np.repeat(bkts, [len(p) for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        n = np.diff(np.r_[first, len(keys)])
        n = np.repeat(n, n)
        many = n > 1
        keys, owner, n = keys[many], owner[many], n[many]
        keys = np.where(n > wide_buckets, keys | WIDE_BIT, keys)
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
        to, at = np.unique(owner, return_index=True)
        ends = np.r_[at[1:], len(owner)]
        rng = t["rng"][0].as_py()
        return pa.table([pa.array(to, pa.int32()), pa.array(np.full(len(to), rng), pa.int32()), pa.array([keys[a:b].astype("<u8").tobytes() for a, b in zip(at, ends)], pa.binary())], schema=ANSWERS)

    return sent.groupBy("rng").applyInArrow(run, "bkt int, rng int, cell binary")


def pair_cells(keys: np.ndarray, contents: np.ndarray, bkt: int, ranges: int) -> pa.Table:
    """Rows of CELLS for the distinct (key, content) pairs of a bucket."""
    order = np.lexsort((contents, keys))
    keys, contents = keys[order], contents[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (contents[1:] != contents[:-1])
    keys, contents = keys[new], contents[new]
    edges = np.searchsorted(range_of(keys, ranges), np.arange(ranges + 1))
    used = np.flatnonzero(np.diff(edges))
    return pa.table([pa.array(used, pa.int32()), pa.array(np.full(len(used), bkt), pa.int32()), pa.array([pack6(keys[edges[r] : edges[r + 1]]) + pack6(contents[edges[r] : edges[r + 1]]) for r in used], pa.binary())], schema=CELLS)


def shared_pairs(sent: DataFrame, wide_contents: int) -> DataFrame:
    """Like shared_keys, for pairs: WIDE_BIT is set on keys with more than `wide_contents` different contents."""

    def run(t: pa.Table) -> pa.Table:
        both = [unpack6(c.as_py()) for c in t["cell"]]
        keys = np.concatenate([x[: len(x) // 2] for x in both])
        contents = np.concatenate([x[len(x) // 2 :] for x in both])
        owner = np.repeat(t["bkt"].to_numpy(), [len(x) // 2 for x in both])
        order = np.lexsort((contents, keys))
        keys, contents, owner = keys[order], contents[order], owner[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        fresh = np.r_[True, (keys[1:] != keys[:-1]) | (contents[1:] != contents[:-1])]
        n = np.diff(np.r_[first, len(keys)])
        many = np.repeat(np.minimum.reduceat(owner, first) < np.maximum.reduceat(owner, first), n)
        keys = np.where(np.repeat(np.add.reduceat(fresh.astype(np.int64), first) > wide_contents, n), keys | WIDE_BIT, keys)[many]
        owner = owner[many]
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        keys, owner = keys[new], owner[new]
        to, at = np.unique(owner, return_index=True)
        ends = np.r_[at[1:], len(owner)]
        return pa.table([pa.array(to, pa.int32()), pa.array(np.full(len(to), t["rng"][0].as_py()), pa.int32()), pa.array([keys[a:b].astype("<u8").tobytes() for a, b in zip(at, ends)], pa.binary())], schema=ANSWERS)

    return sent.groupBy("rng").applyInArrow(run, "bkt int, rng int, cell binary")


def answered(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shared keys of a bucket's answers, and which of them are wide."""
    raw = [np.frombuffer(c.as_py(), "<u8") for c in t["cell"]]
    keys = np.concatenate(raw).astype(np.uint64) if raw else np.zeros(0, np.uint64)
    order = np.argsort(keys & KEY_MASK, kind="stable")
    keys = keys[order]
    return keys & KEY_MASK, (keys & WIDE_BIT) != 0


def member(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of `keys` is in `sorted_keys`, and where."""
    if len(sorted_keys) == 0:
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at
