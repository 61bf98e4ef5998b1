"""Pairs of sets with a large Jaccard similarity t = num / den, all of them, from an index of rare members.

1. Members are put in one order for all sets: by rising frequency, counted in buckets of their hashes so that the counts
   can be sent to every worker whatever the vocabulary, then by hash. Any order gives the same pairs.
2. In a pair the smaller set shares ceil(2 t n / (1 + t)) of its n members or more, the larger one ceil(t n). The first
   j members that both share are thus among the first n - that + j of each; different sets share t / (1 - t) or more,
   so j may be that. These join the two, together with a band of sizes: a set's partners that are not smaller lie in its
   own band or the next. The join keeps what the sizes and the places of the shared members leave possible, and of
   that the pairs that meet j times.
3. The pairs left are compared in full. Pairs of one group of near copies meet in one cell, which gets each set once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..durable import stored

#: Members per bucket of the counts, and the powers of two between which the number of buckets lies.
PER_BUCKET, LEAST_BITS, MOST_BITS = 16, 12, 24
#: Buckets whose counts travel in one row.
BLOCK_BITS = 12
#: Members that are put in order at once.
MEMBERS_AT_ONCE = 1 << 20
#: Members by which a pair must meet, at most.
MEETINGS = 3
#: Rows of keys up to which they are broadcast.
BROADCAST_KEYS = 2_000_000
#: Bytes of sets in one cell, and pairs of one group in one cell.
CELL_BYTES, CELL_PAIRS = 24 << 20, 1 << 19


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(k, sizes, hashes) of some rows at a time."""
    for batch in batches:
        size = pc.list_value_length(batch["hashes"]).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, a = np.cumsum(size), 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MEMBERS_AT_ONCE, "right")))
            yield batch["k"][a:b], size[a:b], batch["hashes"][a:b].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            a = b


def counted(sets: DataFrame, bits: int) -> np.ndarray:
    """How many members of the sets have a hash that begins with each number of `bits` bits; at most 65535."""
    low = min(bits, BLOCK_BITS)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(1 << bits, np.uint32)
        for _, _, h in _parts(batches):
            np.add.at(have, (h >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        at = np.flatnonzero(have)
        edges = np.searchsorted(at, np.arange(0, (1 << bits) + 1, 1 << low))
        used = np.flatnonzero(np.diff(edges))
        cells = [np.ascontiguousarray(np.stack([at[edges[i] : edges[i + 1]] - (i << low), have[at[edges[i] : edges[i + 1]]]]).astype("<u4")).tobytes() for i in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(cells, pa.binary())], names=["block", "cell"])

    def total(t: pa.Table) -> pa.Table:
        have = np.zeros(1 << low, np.int64)
        for c in t["cell"]:
            at, n = np.frombuffer(c.as_py(), "<u4").reshape(2, -1)
            have[at] += n
        return pa.table([t["block"][:1], pa.array([np.minimum(have, 65535).astype("<u2").tobytes()], pa.binary())], names=["block", "cell"])

    out = np.zeros((1 << bits - low, 1 << low), np.uint16)
    for block, cell in sets.select("k", "hashes").mapInArrow(part, "block int, cell binary").groupBy("block").applyInArrow(total, "block int, cell binary").collect():  # 2 bytes a bucket
        out[block] = np.frombuffer(cell, "<u2")
    return out.ravel()


def bands(most: int, t: Fraction) -> np.ndarray:
    """The least sizes of the bands up to `most`: if n <= m <= n / t, m is in n's band or the next."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(edges[-1] * t.denominator // t.numerator + 1)
    return np.array(edges)


def _index(sets: DataFrame, count: np.ndarray, edges: np.ndarray, t: Fraction, j: int, larger: bool, names: list[str]) -> DataFrame:
    """(mark, k, n, room): the first members of each set as one of a pair, and how many it has from there on."""
    bits, num, den = len(count).bit_length() - 1, t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, size, h in _parts(batches):
            doc = np.repeat(np.arange(len(size)), size)
            often = count[(h >> np.uint64(64 - bits)).astype(np.int64)].astype(np.int64)
            order = np.argsort(doc << 16 | often, kind="stable")  # hashes ascend
            room = np.repeat(np.cumsum(size), size) - np.arange(len(doc))
            shares = -(-size * num // den) if larger else -(-size * (2 * num) // (num + den))
            kept = (room + (j - 1) >= shares[doc]) & (often[order] > 1)
            h, doc, room = h[order][kept], doc[kept], room[kept]
            for up in (0,) if larger else (0, 1):
                band = (np.searchsorted(edges, size, "right") + up).astype(np.uint64)[doc]
                mark = (h ^ band * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(mark), k.take(pa.array(doc)), pa.array(size[doc], pa.int32()), pa.array(room, pa.int32())], names=names)

    kind = sets.schema["k"].dataType.simpleString()
    return sets.select("k", "hashes").mapInArrow(run, f"{names[0]} long, {names[1]} {kind}, {names[2]} int, {names[3]} int")


def _sent(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def possible(sets: DataFrame, copies: DataFrame, t: Fraction, members: int, most: int) -> DataFrame:
    """(a, b): pairs of sets that the index leaves possible, a the smaller one; `copies` are left out."""
    num, den = t.numerator, t.denominator
    j = max(1, min(MEETINGS, math.ceil(t / (1 - t))))
    count = counted(sets, min(MOST_BITS, max(LEAST_BITS, (members // PER_BUCKET).bit_length())))
    edges = bands(most, t)
    sets = sets.join(_sent(copies), "k", "left_anti")
    small = _index(sets, count, edges, t, j, False, ["mark", "a", "na", "ra"])
    large = _index(sets, count, edges, t, j, True, ["mark", "b", "nb", "rb"])
    na, nb = F.col("na").cast("long"), F.col("nb").cast("long")
    fits = ((na < nb) | ((na == nb) & (F.col("a") < F.col("b")))) & (na * den >= nb * num) & ((F.least("ra", "rb") + (j - 1)) * F.lit(num + den) >= (na + nb) * num)
    return small.join(large, "mark").filter(fits).groupBy("a", "b").agg(F.count("*").alias("met")).filter(F.col("met") >= j).select("a", "b")


def near_sets(sets: DataFrame, copies: DataFrame, t: Fraction) -> DataFrame:
    """(a, b, similarity) of the pairs with similarity t or more, t below 1, of the stored table `sets` (k, n, hashes
    ascending). All but one k of each set are in `copies`, which get no pairs."""
    members, most = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    pairs = stored(possible(sets, copies, t, members, most), "pairs")
    # Sets that are all near each other have the least of them in common.
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a"))
    group = ends.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("g"))
    of = pairs.join(group.select(F.col("x").alias("a"), F.col("g").alias("ga")), "a").join(group.select(F.col("x").alias("b"), F.col("g").alias("gb")), "b").select("a", "b", F.least("ga", "gb").alias("g"))
    of = stored(of, "grouped")
    parts = of.groupBy("g").agg(F.ceil(F.count("*") / CELL_PAIRS).alias("parts"))
    met = stored(ends.select(F.col("x").alias("k")).distinct().join(sets.select("k", "n"), "k"), "met")
    bytes_ = 8 * (met.agg(F.sum("n")).first()[0] or 0)
    cell = F.pmod(F.xxhash64("g", F.pmod(F.xxhash64("a"), "parts")), F.lit(bytes_ // CELL_BYTES + 1)).alias("cell")
    cells = stored(of.join(parts, "g").select(cell, "a", "b"), "cells")
    asked = stored(cells.select(F.col("cell").alias("of"), F.col("a").alias("k")).union(cells.select("cell", "b")).distinct(), "asked")
    needed = sets.select("k", "hashes").join(_sent(asked), "k")
    num, den = t.numerator, t.denominator

    def compare(asked: pa.Table, have: pa.Table) -> pa.Table:
        keys = have["k"].combine_chunks()
        a, b = (pc.index_in(asked[c].combine_chunks(), keys).to_numpy() for c in "ab")
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        hashes = have["hashes"].combine_chunks()
        size = pc.list_value_length(hashes).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        names, term = np.unique(hashes.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        held, both = np.zeros(len(names), bool), np.zeros(len(a), np.int64)
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else a
        for i, j in zip(starts, np.r_[starts[1:], len(a)]):
            own = term[at[a[i]] : at[a[i] + 1]]
            held[own] = True
            both[i:j] = [np.count_nonzero(held[term[at[x] : at[x + 1]]]) for x in b[i:j]]
            held[own] = False
        union = size[a] + size[b] - both
        near = both * den >= union * num
        return pa.table([keys.take(pa.array(a[near])), keys.take(pa.array(b[near])), pa.array(both[near] / union[near])], names=["a", "b", "similarity"])

    kind = sets.schema["k"].dataType.simpleString()
    return cells.groupBy("cell").cogroup(needed.groupBy("of")).applyInArrow(compare, f"a {kind}, b {kind}, similarity double")
