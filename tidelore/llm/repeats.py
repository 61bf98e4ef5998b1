"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of `size` bytes that covers it also starts in a document with a smaller id.

Plan. Copies leave first: where a task sees a text of at least `size` bytes again with a larger id, that row goes
whole, and only its length travels on. The other documents are dealt by their text to buckets of a few MB, so each
bucket settles the copies that different tasks saw.
1. Each start of a `size`-byte string gets an anchor: the least hash of the grams (24 bytes, in short strings 16) inside the
   string. Equal strings have equal anchors, and neighbouring starts mostly share one, so an anchor
   stands for a short segment of text. Buckets exchange their distinct anchors (exchange.py).
2. Segments whose anchor occurs in two documents or more go, once per bucket and with the smallest id of
   their documents, to the range of their anchor. No range may gather all contexts of a gram that is everywhere, so
   anchors in many buckets are cut once more, by what their strings surely hold beside the gram: those that begin far
   before it hold the bytes before it, the others those behind it. These cores are exchanged like anchors, with a
   hash of their segment: cores that one document has go nowhere, and only those with many different segments, at the
   edges of what is everywhere, are cut into single strings and dealt by content.
3. A range sorts the suffixes of its distinct segments in two stages (suffixes.py); equal strings are
   neighbours, and each start learns the smallest id that has its string.
4. Every bucket marks the bytes of its documents. Step 3's answers travel back, and with them, packed, where
   step 2 found the bucket's segments, so that it does not look for them again.

Anchors only propose; strings are compared byte by byte in step 3.

Cases: null and empty texts have no bytes; rows that repeat an id don't remove each other's bytes, as
neither id is smaller; a row with a null id is neither removed from nor counts as an earlier one; texts of any
length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import exchange
from .common import buckets_for, mix64, text_buffer, text_bytes
from .suffixes import smallest_owner

SIZE = 50
#: Bytes of a gram; strings of LONG_SIZE bytes or more have long ones, which fewer texts share by chance.
GRAM, LONG_GRAM, LONG_SIZE = 16, 24, 48
#: Longest run of starts in a segment, and the text that one suffix array holds.
RUN = 64
ARRAY_BYTES = 2 << 20
#: Bytes of text whose segments one range sorts.
SORT_RANGE_BYTES = 16 << 20
#: A core with more different segments than this is cut into single strings.
WIDE_SEGMENTS = 64
NO_ID = np.iinfo(np.int64).max

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def gram_bytes(size: int) -> int:
    return LONG_GRAM if size >= LONG_SIZE else GRAM


def grams(data: np.ndarray, length: int) -> np.ndarray:
    """The mixed hash of each gram of `length` bytes, GRAM or LONG_GRAM."""
    h = _BYTE[data]
    for k, mul in enumerate(_MUL):
        step, half = 1 << k, h
        h = h[:-step] * mul + h[step:]
    if length == LONG_GRAM:  # half: the 8-byte grams
        h = h[: len(data) - length + 1] * _MUL[2] + half[GRAM : len(data) - length + 1 + GRAM]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, size: int) -> np.ndarray:
    """For each start of a string of `size` bytes, the least hash of its grams."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    window = size - gram_bytes(size) + 1
    for a in range(0, n, 1 << 16):
        b = min(n, a + (1 << 16))
        h = grams(data[a : b + size - 1], gram_bytes(size))
        span = 1
        while 2 * span <= window:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        rest = window - span
        out[a:b] = np.minimum(h[: len(h) - rest], h[rest:]) if rest else h
    return out


def deal(docs: DataFrame, id_col: str, text_col: str, n_buckets: int, size: int) -> DataFrame:
    """(bkt, doc_id, text, n_bytes): the text is null where the row is known to be a later copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        for batch in batches:
            data, off = text_buffer(batch["text"])
            view, ids = memoryview(data), batch["doc_id"].to_pylist()
            bkts, live = np.empty(len(ids), np.int32), np.ones(len(ids), bool)
            for k, (i, a, b) in enumerate(zip(ids, off[:-1].tolist(), off[1:].tolist())):
                mark = hashlib.blake2b(view[a:b], digest_size=16).digest()
                bkts[k] = int.from_bytes(mark[:8], "little") % n_buckets
                if i is None or b - a < size:
                    continue
                seen = least.get(mark)
                if seen is None or i < seen:
                    least[mark] = i
                elif i > seen:
                    live[k] = False
                    bkts[k] = i % n_buckets
            texts = pa.array(batch["text"].to_pylist(), pa.string(), mask=~live) if not live.all() else batch["text"]
            yield pa.RecordBatch.from_arrays([pa.array(bkts), batch["doc_id"], texts, pa.array(np.diff(off), pa.int64())], names=["bkt", "doc_id", "text", "n_bytes"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "bkt int, doc_id long, text string, n_bytes long")


_EMPTY = hashlib.sha256(b"").hexdigest()


class Bucket:
    """A bucket's documents and, if wanted, their runs of equal anchors; of equal texts only those with the least id count."""

    def __init__(self, t: pa.Table, size: int, runs: bool = True) -> None:
        # Shuffled rows come in any order; every stage must number segments alike.
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        later = t["text"].is_null().to_numpy()
        texts, ids = t["text"].to_pylist(), t["doc_id"].to_pylist()
        least: dict[str, int] = {}
        for i, x in zip(ids, texts):
            if i is not None and x is not None and (x not in least or i < least[x]):
                least[x] = i
        later = later | np.array([i is not None and x is not None and i > least[x] and n >= size for i, x, n in zip(ids, texts, t["n_bytes"].to_pylist())], bool)
        self.copies = t.filter(pa.array(later)).select(["doc_id", "n_bytes"])
        t = t.filter(pa.array(~later))
        self.data, self.off = text_buffer(t["text"])
        self.ids = t["doc_id"].to_pylist()
        self.doc_id = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        if runs:
            self._runs(size)

    def _runs(self, size: int) -> None:
        hashes = anchors(self.data, size)
        n = len(hashes)
        change = np.ones(n, bool)
        change[1:] = hashes[1:] != hashes[:-1]
        inner = self.off[1:-1]
        change[inner[inner < n]] = True
        valid = np.ones(n, bool)
        for end in self.off[1:]:
            valid[max(0, end - size + 1) : end] = False
        change[1:] |= valid[1:] & ~valid[:-1]
        at = np.flatnonzero(change & valid)
        stop = np.flatnonzero(np.r_[change, True] | ~np.r_[valid, False])
        end = stop[np.searchsorted(stop, at, "right")]
        pieces = -(-(end - at) // RUN)
        first = np.repeat(np.cumsum(pieces) - pieces, pieces)
        k = np.arange(len(first)) - first
        self.start = np.repeat(at, pieces) + k * RUN
        self.stop = np.minimum(np.repeat(end, pieces), self.start + RUN)
        self.key = mix64(hashes[self.start]) >> np.uint64(16) if n else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.off, self.start, "right") - 1

    def taken(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The runs whose anchor two documents have, and which of these anchors are wide."""
        keys, wide = exchange.answered(answers)
        found, at = exchange.member(keys, self.key)
        take = np.flatnonzero(found | exchange.member(_in_two(self.key, self.doc), self.key)[0])
        return take, (found & (wide[at] if len(wide) else False))[take]

    def cores(self, runs: np.ndarray, size: int) -> "Cores":
        """What the runs of wide anchors are cut into: stretches of starts with the same core."""
        start, stop, doc = self.start[runs], self.stop[runs], self.doc[runs]
        gram = gram_bytes(size)
        window = np.arange(size - gram + 1)
        half = len(window) // 2
        h = grams(self.data, gram) if len(start) else np.zeros(0, np.uint64)
        found: list[tuple[np.ndarray, ...]] = [(start[:0], stop[:0], doc[:0], start[:0], np.zeros(0, bool))]
        while len(start):
            at = np.empty(len(start), np.int64)
            for a in range(0, len(start), 1 << 15):
                at[a : a + (1 << 15)] = h[start[a : a + (1 << 15), None] + window].argmin(1)  # the first of equal ones: the same in equal strings
            least = start + at
            end = np.minimum(stop, least + 1)  # later starts of the run have a later gram
            near = np.clip(least - half + 1, start, end)  # the first start that the gram is less than half a window behind
            for lo, hi, core, far in ((start, near, least - half, True), (near, end, least, False)):
                some = lo < hi
                found.append((lo[some], hi[some], doc[some], core[some], np.full(some.sum(), far)))
            left = end < stop
            start, stop, doc = end[left], stop[left], doc[left]
        s, stop, doc, core, far = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(s)
        s, stop, doc, core, far = s[order], stop[order], doc[order], core[order], far[order]
        raw = self.data.tobytes()
        length = np.where(far, half + gram, size - half + 1)
        mark = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=6).digest(), "little")
        keys = [mark((b"<" if f else b">") + raw[c : c + m]) for c, m, f in zip(core.tolist(), length.tolist(), far.tolist())]
        contents = [mark(raw[a : b + size - 1]) for a, b in zip(s.tolist(), stop.tolist())]
        return Cores(s, stop, doc, np.array(keys, np.uint64), np.array(contents, np.uint64))

    def segments(self, anchored: pa.Table, cored: pa.Table, size: int, ranges: int) -> tuple[list[bytes], np.ndarray, "Segments"]:
        """The bytes and keys of the distinct segments that another document may share, and where they are."""
        take, wide = self.taken(anchored)
        plain, cut = take[~wide], self.cores(take[wide], size)
        keys, many = exchange.answered(cored)
        found, at = exchange.member(keys, cut.key)
        live = found | exchange.member(_in_two(cut.key, cut.doc), cut.key)[0]
        single = found & (many[at] if len(many) else False)
        whole, split = live & ~single, live & single
        n = (cut.stop - cut.start)[split]
        one = np.repeat(cut.start[split] - np.cumsum(n) + n, n) + np.arange(n.sum())
        raw = self.data.tobytes()
        pieces: list[bytes] = []
        own_key, begins, segs = [], [], []
        # Equal bytes have equal keys within each of the three.
        for begin, end, key in ((self.start[plain], self.stop[plain], self.key[plain]), (cut.start[whole], cut.stop[whole], cut.key[whole]), (one, one + 1, None)):
            number: dict[bytes, int] = {}
            seg = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(begin.tolist(), (end + (size - 1)).tolist())], np.int64)
            new = np.flatnonzero(np.diff(np.maximum.accumulate(seg), prepend=-1))
            own_key.append(key[new] if key is not None else np.array([int.from_bytes(hashlib.blake2b(p, digest_size=6).digest(), "little") for p in number], np.uint64))
            begins.append(begin)
            segs.append(seg + len(pieces))
            pieces.extend(number)
        keys = np.concatenate(own_key)
        starts = np.array([len(p) for p in pieces], np.int64) - (size - 1)
        return pieces, keys, Segments(np.concatenate(begins), np.concatenate(segs), starts, exchange.range_of(keys, ranges))


@dataclass
class Cores:
    """Stretches of starts (from start to before stop), the hash of their common core, and of all their bytes."""

    start: np.ndarray
    stop: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    content: np.ndarray


def _in_two(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The keys that two documents have, ascending."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    return np.unique(k[np.flatnonzero((k[1:] == k[:-1]) & (d[1:] != d[:-1])) + 1])


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers of 32 bits, packed byte by byte."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _loosen(cell: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(cell), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


@dataclass
class Segments:
    """Of every occurrence of a segment, its first start and its number; of every segment, its starts and its range."""

    begin: np.ndarray
    seg: np.ndarray
    starts: np.ndarray
    rng: np.ndarray

    def by_range(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each range and the numbers of its segments."""
        order = np.argsort(self.rng, kind="stable")
        used, at = np.unique(self.rng[order], return_index=True)
        for r, own in zip(used.tolist(), np.split(order, at[1:])):
            yield r, own

    def least(self, who: np.ndarray) -> np.ndarray:
        """The smallest id of each segment's occurrences, whose documents have the ids `who`."""
        out = np.full(len(self.starts), NO_ID, np.int64)
        np.minimum.at(out, self.seg, who)
        return out

    def packed(self) -> list[bytes]:
        return [_squeeze(np.diff(self.begin, prepend=0)), _squeeze(np.diff(self.seg, prepend=0)), _squeeze(self.starts), _squeeze(self.rng)]

    @classmethod
    def unpacked(cls, cells: list[bytes]) -> "Segments":
        begin, seg, starts, rng = map(_loosen, cells)
        signed = lambda x: np.cumsum(x.astype(np.uint32).view(np.int32), dtype=np.int64)
        return cls(signed(begin), signed(seg), starts, rng)


def _sort_range(t: pa.Table, size: int) -> Iterator[tuple[int, bytes]]:
    """(bkt, answer) for each bucket's segments of this range; an answer lists runs (segment, starts, id)."""
    parts = []
    for row in zip(t["bkt"].to_pylist(), t["keys"].to_pylist(), t["ids"].to_pylist(), t["lens"].to_pylist(), t["text"].to_pylist()):
        ids, text = (zstandard.decompress(c) for c in (row[2], row[4]))
        parts.append((row[0], exchange.unpack6(row[1]), np.frombuffer(ids, "<i8"), np.frombuffer(row[3], "<u2"), text))
    # Distinct segments of the range; the same bytes from several buckets are sorted once.
    number: dict[bytes, int] = {}
    key, least, refs = [], [], []
    for _, keys, ids, lens, text in parts:
        at, mine = 0, np.empty(len(keys), np.int64)
        for j, (k, i, n) in enumerate(zip(keys.tolist(), ids.tolist(), lens.tolist())):
            piece = text[at : at + n]
            at += n
            s = number.setdefault(piece, len(key))
            if s == len(key):
                key.append(k)
                least.append(i)
            elif i < least[s]:
                least[s] = i
            mine[j] = s
        refs.append(mine)
    pieces = list(number)
    lens = np.array([len(p) for p in pieces], np.int64)
    starts_of = lens - size + 1
    begin = np.concatenate([[0], np.cumsum(starts_of)])
    smallest = np.empty(begin[-1], np.int64)
    least = np.array(least, np.int64)
    order = np.argsort(np.array(key, np.uint64), kind="stable")
    sorted_key = np.array(key, np.uint64)[order]
    # Equal strings have equal anchors: a segment that is its anchor's only one needs no sorting.
    differ = np.r_[True, sorted_key[1:] != sorted_key[:-1], True]
    only = order[differ[:-1] & differ[1:]]
    smallest[np.repeat(begin[only], starts_of[only]) + np.arange(starts_of[only].sum()) - np.repeat(np.cumsum(starts_of[only]) - starts_of[only], starts_of[only])] = np.repeat(least[only], starts_of[only])
    several = ~(differ[:-1] & differ[1:])
    order, sorted_key = order[several], sorted_key[several]
    a = 0
    while a < len(order):  # arrays of bounded size, cut where the key changes
        b, total = a, 0
        while b < len(order) and (total < ARRAY_BYTES or sorted_key[b] == sorted_key[b - 1]):
            total += int(lens[order[b]]) + 1
            b += 1
        own = order[a:b]
        text = np.frombuffer(b"\xff".join(pieces[s] for s in own) + b"\xff", np.uint8) + np.uint8(1)  # no UTF-8 byte is 255: separators become 0
        base = np.concatenate([[0], np.cumsum(lens[own] + 1)])[:-1]
        n = starts_of[own]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        got = smallest_owner(text, np.repeat(base, n) + inside, np.repeat(least[own], n), size)
        smallest[np.repeat(begin[own], n) + inside] = got
        a = b
    run_new = np.ones(len(smallest), bool)
    run_new[1:] = smallest[1:] != smallest[:-1]
    run_new[begin[:-1]] = True
    run_at = np.flatnonzero(run_new)
    run_of = np.searchsorted(run_at, begin)  # first run of each segment
    run_len = np.diff(np.r_[run_at, len(smallest)])
    for (bkt, _, ids, _, _), mine in zip(parts, refs):
        n_runs = run_of[mine + 1] - run_of[mine]
        first = run_of[mine]
        plain = (n_runs == 1) & (smallest[run_at[first]] == ids)  # nothing smaller elsewhere: the bucket knows
        n_runs = np.where(plain, 0, n_runs)
        idx = np.repeat(first, n_runs) + np.arange(n_runs.sum()) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
        yield bkt, n_runs.astype("<u1").tobytes() + run_len[idx].astype("<u1").tobytes() + smallest[run_at[idx]].astype("<i8").tobytes()


def _marks(b: Bucket, parts: Segments, replies: dict[int, bytes], size: int) -> np.ndarray:
    """Which bytes of the bucket go."""
    begin, seg, length, n_seg = parts.begin, parts.seg, parts.starts, len(parts.starts)
    doc = np.searchsorted(b.off, begin, "right") - 1
    least = parts.least(b.doc_id[doc])
    seg_of, len_of, id_of = [], [], []
    for r, own in parts.by_range():
        raw = replies[r]
        n_runs = np.frombuffer(raw, "<u1", len(own)).astype(np.int64)
        total = int(n_runs.sum())
        run_len = np.frombuffer(raw, "<u1", total, len(own)).astype(np.int64)
        ids = np.frombuffer(raw, "<i8", total, len(own) + total)
        seg_of.append(np.repeat(own, n_runs))
        len_of.append(run_len)
        id_of.append(ids)
        plain = own[n_runs == 0]
        seg_of.append(plain)
        len_of.append(length[plain])
        id_of.append(least[plain])
    out = np.zeros(len(b.data) + 1, np.int64)
    if n_seg:
        s, n, i = np.concatenate(seg_of), np.concatenate(len_of), np.concatenate(id_of)
        order = np.argsort(s, kind="stable")
        s, n, i = s[order], n[order], i[order]
        per = np.bincount(s, minlength=n_seg)
        first = np.cumsum(per) - per
        at = np.cumsum(n) - n
        at = at - np.repeat(at[first], per)  # first start of the run within its segment
        k = per[seg]
        idx = np.repeat(first[seg], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        who = b.doc_id[np.repeat(doc, k)]
        gone = (i[idx] < who) & (who != NO_ID)
        lo = (np.repeat(begin, k) + at[idx])[gone]
        hi = lo + n[idx][gone] + size - 1
        out += np.bincount(lo, minlength=len(out)) - np.bincount(hi, minlength=len(out))
    return np.cumsum(out[:-1]) > 0


def _report(b: Bucket, gone: np.ndarray) -> pa.Table:
    before = np.concatenate([[0], np.cumsum(gone)])
    n_removed = before[b.off[1:]] - before[b.off[:-1]]
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    starts = b.off[:-1][b.off[:-1] < len(gone)]
    edge[starts] = gone[starts]
    edges = np.concatenate([[0], np.cumsum(edge)])
    n_spans = edges[b.off[1:]] - edges[b.off[:-1]]
    view, sums = memoryview(b.data), []
    for a, e, n in zip(b.off[:-1].tolist(), b.off[1:].tolist(), n_removed.tolist()):
        sums.append(hashlib.sha256(b.data[a:e][~gone[a:e]].tobytes() if n else view[a:e]).hexdigest())
    out = pa.table({"doc_id": pa.array(b.ids, pa.int64()), "n_bytes": np.diff(b.off), "n_removed": n_removed, "n_spans": n_spans, "kept_sha256": pa.array(sums, pa.string())})
    n, size = b.copies.num_rows, b.copies["n_bytes"]
    gone_whole = pa.table({"doc_id": b.copies["doc_id"], "n_bytes": size, "n_removed": size, "n_spans": pa.array([1] * n, pa.int64()), "kept_sha256": pa.array([_EMPTY] * n, pa.string())})
    return pa.concat_tables([out, gone_whole])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, bucket_bytes: int = 4 << 20, wide_buckets: int = exchange.WIDE_BUCKETS, wide_segments: int = WIDE_SEGMENTS, sort_bytes: int = SORT_RANGE_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    if not GRAM <= size <= 200:
        raise ValueError(f"size must be from {GRAM} to 200")
    total = text_bytes(docs, text_col)
    ranges, sort_ranges = buckets_for(total, exchange.RANGE_BYTES), buckets_for(total, sort_bytes)
    dealt = deal(docs, id_col, text_col, buckets_for(total, bucket_bytes), size)

    def send(t: pa.Table) -> pa.Table:
        return exchange.cells(Bucket(t, size).key, t["bkt"][0].as_py(), ranges)

    def core(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return exchange.CELLS.empty_table()
        b = Bucket(left, size)
        take, wide = b.taken(right)
        cores = b.cores(take[wide], size)
        return exchange.pair_cells(cores.key, cores.content, left["bkt"][0].as_py(), ranges)

    def part(t: pa.Table, kind: int) -> pa.Table:
        return t.filter(pa.array(np.array(t["kind"].to_pylist(), int) == kind))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"rng": [], "bkt": [], "keys": [], "ids": [], "lens": [], "text": []}
        if left.num_rows:
            b = Bucket(left, size)
            pieces, key, parts = b.segments(part(right, 0), part(right, 1), size, sort_ranges)
            least = parts.least(b.doc_id[np.searchsorted(b.off, parts.begin, "right") - 1])
            bkt, squeeze = left["bkt"][0].as_py(), zstandard.ZstdCompressor(level=1).compress
            rows = [(r, bkt, exchange.pack6(key[own]), squeeze(least[own].astype("<i8").tobytes()), (parts.starts[own] + (size - 1)).astype("<u2").tobytes(), squeeze(b"".join([pieces[n] for n in own.tolist()]))) for r, own in parts.by_range()]
            # Where the bucket's segments are comes back to it with the answers, by a range of its own.
            for row in [*rows, (sort_ranges + bkt, bkt, *parts.packed())]:
                for c, v in zip(out, row):
                    out[c].append(v)
        return pa.table({c: pa.array(v, pa.int32() if c in ("rng", "bkt") else pa.binary()) for c, v in out.items()})

    def settle(t: pa.Table) -> pa.Table:
        rng = t["rng"][0].as_py()
        if rng >= sort_ranges:
            bkt, own = t["bkt"][0].as_py(), ("keys", "ids", "lens", "text")
            return pa.table([pa.array([bkt] * 4, pa.int32()), pa.array([-1 - k for k in range(4)], pa.int32()), pa.array([t[c][0].as_py() for c in own], pa.binary())], names=["bkt", "rng", "cell"])
        rows = list(_sort_range(t, size))
        return pa.table([pa.array([b for b, _ in rows], pa.int32()), pa.array([rng] * len(rows), pa.int32()), pa.array([c for _, c in rows], pa.binary())], names=["bkt", "rng", "cell"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = dict(zip(right["rng"].to_pylist(), right["cell"].to_pylist()))
        b, parts = Bucket(left, size, runs=False), Segments.unpacked([replies[-1 - k] for k in range(4)])
        return _report(b, _marks(b, parts, replies, size))

    def of(kind: int, df: DataFrame) -> DataFrame:
        return df.withColumn("kind", F.lit(kind))

    cells = "rng int, bkt int, cell binary"
    anchored = exchange.shared_keys(dealt.groupBy("bkt").applyInArrow(send, cells), wide_buckets)
    cored = exchange.shared_pairs(dealt.groupBy("bkt").cogroup(anchored.groupBy("bkt")).applyInArrow(core, cells), wide_segments)
    shared = of(0, anchored).unionByName(of(1, cored))
    segments = dealt.groupBy("bkt").cogroup(shared.groupBy("bkt")).applyInArrow(cut, "rng int, bkt int, keys binary, ids binary, lens binary, text binary")
    replies = segments.groupBy("rng").applyInArrow(settle, "bkt int, rng int, cell binary")
    return dealt.groupBy("bkt").cogroup(replies.groupBy("bkt")).applyInArrow(finish, RESULT)
