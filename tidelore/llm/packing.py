"""Best-fit packing with large-item matching.

Token pieces longer than a third of the capacity fit at most twice into a sequence, so they are matched
greedily, the longest with the longest that still fits; the other pieces go, longest first, into the
tightest gap. The packing depends on nothing but how many pieces have each length, so it is solved once on
that histogram (at most `capacity` numbers) as runs of equal moves, and every piece looks up its place by
its rank among the pieces of its length. No step gathers pieces.

Cases: null and empty texts are one piece, the end id alone; a literal `<|endoftext|>` in a text is the vocabulary's
added token 50256; texts of any length are encoded whole; only documents over the capacity are cut, the
first piece being the shorter; repeated rows, repeated ids and null ids are packed each row for itself; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialize

CAPACITY = 2048
END_ID = 0
#: The added token of byte_bpe_50k.json; it has an id of its own wherever it stands in a text.
ADDED = {"<|endoftext|>": 50256}
#: Pieces whose ranks one window settles.
RANKED_ROWS = 100_000


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """Byte-level BPE over the ranks file of the same vocabulary; with the added token allowed, equal to the JSON file's
    ids (tested), and several times as fast. Unless a call allows it, the added token is ordinary text."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=ADDED)


@lru_cache(maxsize=2)
def _whole(json_path: str, added: bool):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(json_path)
    out.encode_special_tokens = not added
    return out


def token_ids(text: str, ranks_path: str, pattern: str, added: bool) -> np.ndarray:
    """Ids of a text; `added`: the literal of the added token gets its id, else it is ordinary text. Where the fast library
    gives up (runs of about a million blanks), the JSON file of the same name gives the same ids."""
    enc = encoding(ranks_path, pattern)
    try:
        return enc.encode_to_numpy(text, allowed_special="all") if added else enc.encode_to_numpy(text, disallowed_special=())
    except ValueError:
        return np.array(_whole(f"{os.path.splitext(ranks_path)[0]}.json", added).encode(text, add_special_tokens=False).ids, np.uint32)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocab: tuple[str, str] | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's pieces."""
    path, pattern = vocab or vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.append(token_ids(text, path, pattern, True), end_id).astype("<u4")
                n = len(ids)
                first = n - (math.ceil(n / capacity) - 1) * capacity
                at = 0
                for k, stop in enumerate(range(first, n + 1, capacity)):
                    own = ids[at:stop]
                    rows.append((i, k, at, len(own), zlib.crc32(own.tobytes()), *([own.tolist()] if keep_ids else [])))
                    at = stop
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    )


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Moves (length, first rank, how many, first sequence, offset): the r-th piece of a length goes to the r-th sequence of its move."""
    left = dict(counts)
    rank: dict[int, int] = defaultdict(int)
    moves: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, how many)
    open_gaps: list[int] = []
    made = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        moves.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n

    def offer(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if not gaps[gap]:
                insort(open_gaps, gap)
            gaps[gap].append((first, n))

    large = sorted((x for x, n in left.items() if 3 * x > capacity and n > 0), reverse=True)
    mates = sorted(large)
    for x in large:
        while left[x] > 0:
            while mates and left[mates[-1]] == 0:
                mates.pop()
            k = bisect_left(mates, capacity - x + 1) - 1
            while k >= 0 and (left[mates[k]] == 0 or mates[k] > x):
                k -= 1
            y = mates[k] if k >= 0 else None
            if y == x and left[x] < 2:
                y = next((m for m in reversed(mates[:k]) if left[m] > 0), None)
            n = left[x] if y is None else left[x] // 2 if y == x else min(left[x], left[y])
            put(x, n, made, 0)
            if y is not None:
                put(y, n, made, x)
            offer(capacity - x - (y or 0), made, n)
            made += n
    for x in sorted((x for x, n in left.items() if n > 0), reverse=True):
        while left[x] > 0:
            k = bisect_left(open_gaps, x)
            if k == len(open_gaps):
                each = capacity // x
                n, rest = divmod(left[x], each)
                for j in range(each if n else 0):
                    put(x, n, made, j * x)
                offer(capacity - each * x, made, n)
                made += n
                for j in range(rest):
                    put(x, 1, made, j * x)
                if rest:
                    offer(capacity - rest * x, made, 1)
                    made += 1
                continue
            gap = open_gaps[k]
            first, n = gaps[gap].pop()
            if n > left[x]:
                gaps[gap].append((first + left[x], n - left[x]))
                n = left[x]
            if not gaps[gap]:
                open_gaps.pop(k)
            put(x, n, first, capacity - gap)
            offer(gap - x, first, n)
    return moves


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (read more than once)."""
    spark = pieces.sparkSession
    salts = max(1, math.ceil(pieces.count() / RANKED_ROWS))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    ahead = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    counts = materialize(counts, "lengths")
    ranked = salted.withColumn("_own", F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(counts, ["length", "_salt"]).withColumn("_rank", F.col("_ahead") + F.col("_own") - 1)
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    moves = sorted(plan(by_length, capacity))
    # Keys (length, first rank) ascend; a piece belongs to the last move at or before it.
    where = spark.sparkContext.broadcast(np.array(moves, np.int64).reshape(-1, 5))
    keep = [c for c in pieces.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = where.value
        edges = np.searchsorted(m[:, 0], np.arange(capacity + 2))
        for pdf in batches:
            length, r = pdf["length"].to_numpy(np.int64), pdf["_rank"].to_numpy(np.int64)
            row = np.zeros(len(pdf), np.int64)
            for x in np.unique(length):
                sel = length == x
                row[sel] = edges[x] + np.searchsorted(m[edges[x] : edges[x + 1], 1], r[sel], "right") - 1
            yield pdf[keep].assign(sequence_id=m[row, 3] + r - m[row, 1], offset=m[row, 4])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*keep, "_rank").mapInPandas(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False, **kw: object) -> DataFrame:
    """Tokenizes, cuts and packs `docs`: one row per piece with its sequence and offset."""
    return pack_pieces(materialize(token_pieces(docs, capacity=capacity, keep_ids=keep_ids, **kw), "pieces"), capacity)
