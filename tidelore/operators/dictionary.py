"""The versioned dictionary: an ordered fold of atoms per kind.

Whether an atom is new, a restatement or a conflict depends on what came before it, so each kind is folded in order
(turn, rank). Candidates come from an inverted index over terms, not from a scan of all entries.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K
from ..functions.features import TERM, heaviest, lists_array, text_terms, texts_of
from ..functions.numbering import numbered
from ..functions.text import fingerprint, looked_up

SIMILAR = 0.80
CANDIDATES = 20
TERMS = 48

EVENTS = "kind string, turn_id long, rank int, content string, confidence double, authority double, fingerprint string, event string, target_turn long, target_rank int, version int, status string, old_turn long, old_rank int"


def with_terms(atoms: DataFrame, max_terms: int = TERMS) -> DataFrame:
    """Adds `terms` (term, tenths), the heaviest features of the content, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = lists_array([heaviest(text_terms(x), max_terms) for x in texts_of(batch["content"])])
            yield pa.RecordBatch.from_arrays([*batch.columns, terms], names=[*batch.schema.names, "terms"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in atoms.schema)
    return atoms.mapInArrow(run, f"{fields}, terms {TERM}")


class _Active:
    """The active entries of one kind, found by their terms.

    Terms are numbered from rare to frequent. Sets of similarity t share one of the first n - ceil(t n) + 1 terms of each, so
    only these lead to similar entries; entries that share more weight than a given one hold a term of any choice
    whose other terms weigh less than it does.
    """

    def __init__(self, terms: array, off: list[int]) -> None:
        self.terms, self.off = terms, off
        self.alive = bytearray(len(off))
        self.first: dict[int, list[int]] = {}
        self.all: dict[int, list[int]] = {}
        self.gone: dict[int, int] = defaultdict(int)

    def of(self, e: int) -> array:
        return self.terms[self.off[e] : self.off[e + 1]]

    @staticmethod
    def least(n: int) -> int:
        """ceil(SIMILAR * n)."""
        return (4 * n + 4) // 5

    def add(self, e: int) -> None:
        own = self.of(e)
        self.alive[e] = 1
        for i, t in enumerate(own):
            if i <= len(own) - self.least(len(own)):
                self.first.setdefault(t, []).append(e)
            self.all.setdefault(t, []).append(e)

    def drop(self, e: int) -> None:
        self.alive[e] = 0
        for t in self.of(e):
            self.gone[t] += 1
            if 2 * self.gone[t] > len(self.all[t]):
                self.gone[t] = 0
                for lists in (self.all, self.first):
                    if t in lists:
                        lists[t] = [x for x in lists[t] if self.alive[x]]

    def similar(self, own: dict[int, int]) -> list[tuple[float, int, int]]:
        """(similarity, shared weight, entry) of all active entries that are similar to the terms, best first."""
        n, met, out = len(own), set(), []
        for t in list(own)[: n - self.least(n) + 1]:
            met.update(self.first.get(t, ()))
        for e in met:
            size = self.off[e + 1] - self.off[e]
            if self.alive[e] and 4 * n <= 5 * size and 4 * size <= 5 * n:
                shared = own.keys() & self.of(e)
                if 5 * len(shared) >= 4 * (n + size - len(shared)):
                    out.append((len(shared) / (n + size - len(shared)), sum(own[t] for t in shared), e))
        return sorted(out, reverse=True)

    def among_heaviest(self, own: dict[int, int], weight: int, entry: int) -> bool:
        """Whether fewer than CANDIDATES active entries come before this one by shared weight, then by number."""
        before, left, seen = 0, sum(own.values()), set()
        most = left
        for t in sorted(own, key=lambda t: len(self.all.get(t, ()))):
            for e in reversed(self.all.get(t, ())):
                if weight == most and e <= entry:
                    break
                if self.alive[e] and e not in seen:
                    seen.add(e)
                    before += (sum(own.get(x, 0) for x in self.of(e)), e) > (weight, entry)
                    if before >= CANDIDATES:
                        return False
            left -= own[t]
            if left < weight:
                break
        return True

    def nearest(self, own: dict[int, int]) -> int | None:
        """Of the CANDIDATES heaviest entries, the most similar one."""
        return next((e for _, weight, e in self.similar(own) if self.among_heaviest(own, weight, e)), None)


def _fold(t: pa.Table) -> pa.Table:
    t = t.sort_by([("turn_id", "ascending"), ("rank", "ascending")])
    lists = t["terms"].combine_chunks()
    size = lists.value_lengths().fill_null(0).to_numpy()
    flat = lists.flatten()
    codes = flat.field("term").dictionary_encode().indices.to_numpy()
    by_count = np.argsort(np.bincount(codes), kind="stable")
    number = np.empty(len(by_count), np.int64)
    number[by_count] = np.arange(len(by_count))
    order = np.lexsort((number[codes], np.repeat(np.arange(len(size)), size)))
    off = [0, *np.cumsum(size).tolist()]
    terms = array("q", number[codes][order].tobytes())
    tenths = array("q", flat.field("tenths").to_numpy()[order].astype(np.int64).tobytes())
    index = _Active(terms, off)
    n = t.num_rows
    authority, marks = t["authority"].to_pylist(), t["fingerprint"].to_pylist()
    active: dict[str, int] = {}
    target, old, version, superseded = list(range(n)), [None] * n, [1] * n, bytearray(n)
    for r in range(n):
        hit = active.get(marks[r])
        if hit is None and off[r] < off[r + 1]:
            near = index.nearest(dict(zip(index.of(r), tenths[off[r] : off[r + 1]])))
            if near is not None and authority[r] >= authority[near]:
                superseded[near] = 1
                version[r], old[r] = version[near] + 1, near
                active.pop(marks[near], None)
                index.drop(near)
            else:
                hit = near
        if hit is not None:
            target[r] = hit
        else:
            active[marks[r]] = r
            index.add(r)
    new = np.array(target, np.int64) == np.arange(n)
    state = np.where(np.frombuffer(superseded, np.uint8) > 0, "superseded", "active")
    replaced = pa.array(old, pa.int64())
    cols = {c: t[c] for c in ("kind", "turn_id", "rank", "content", "confidence", "authority", "fingerprint")}
    cols |= {"event": pa.array(np.where(new, "insert", "link").tolist(), pa.string()), "target_turn": t["turn_id"].take(pa.array(target)), "target_rank": t["rank"].take(pa.array(target))}
    cols |= {"version": pa.array(version, pa.int32(), mask=~new), "status": pa.array(state.tolist(), pa.string(), mask=~new), "old_turn": t["turn_id"].take(replaced), "old_rank": t["rank"].take(replaced)}
    return pa.table(cols)


def fold(atoms: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Events of (turn_id, role, rank, kind, content, confidence): `insert` or `link`, folded per kind (and `scope`)."""
    a = atoms.withColumn("authority", looked_up(F.col("role"), K.AUTHORITY, 0.55)) if "authority" not in atoms.columns else atoms
    a = with_terms(a).withColumn("fingerprint", fingerprint(F.concat("kind", F.lit("\n"), "content"))).withColumn("rank", F.col("rank").cast("int"))
    return a.groupBy("kind", *(scope or [])).applyInArrow(_fold, EVENTS)


def entries(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, entry_sources) of the fold's events; ids follow the order of insertion."""
    made = numbered(events.filter("event = 'insert'"), ["turn_id", "rank"], "entry_id")
    ids = made.select(F.col("turn_id").alias("_t"), F.col("rank").alias("_r"), F.col("entry_id").alias("_id"))
    old = made.join(ids.withColumnRenamed("_id", "supersedes_id"), (F.col("old_turn") == F.col("_t")) & (F.col("old_rank") == F.col("_r")), "left")
    table = old.select("entry_id", "kind", "content", "confidence", "authority", "status", "version", "fingerprint", F.col("turn_id").alias("source_turn_id"), "supersedes_id")
    links = events.join(ids, (F.col("target_turn") == F.col("_t")) & (F.col("target_rank") == F.col("_r"))).select(F.col("_id").alias("entry_id"), "turn_id").distinct()
    return table, links
