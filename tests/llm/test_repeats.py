"""Suffix-array removal against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tidelore.llm.repeats import Bucket, Segments, anchors, gram_bytes, grams, remove_repeats
from tidelore.llm.suffixes import suffix_order


def brute(rows, size=50):
    owner = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for p in range(len(b) - size + 1):
                s = b[p : p + size]
                owner[s] = min(owner.get(s, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - size + 1):
                if owner[b[p : p + size]] < i:
                    gone[p : p + size] = b"\1" * size
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_for(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(80)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    common = say(14)
    base = say(200)
    rows = [(i, say(rng.randint(0, 60))) for i in range(20)]
    rows += [(i, say(10) + common + say(rng.randint(0, 30))) for i in range(20, 45)]
    rows += [(i, base[: rng.randint(0, 500)] + "X" + base[rng.randint(0, 500) :]) for i in range(45, 60)]
    rows += [(60, None), (61, ""), (62, base), (63, base), (63, base), (None, base), (64, "-" * 400), (65, "-" * 300), (66, "ab" * 200), (67, "x" * 49), (68, "x" * 50), (69, "\0" * 60), (70, "\0" * 70)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,wide,many,size", [(1, 64, 64, 50), (2, 0, 64, 50), (3, 0, 1, 50), (4, 0, 0, 50), (5, 1, 2, 200), (6, 0, 0, 16)])
def test_removal_equals_brute_force(spark, seed, wide, many, size):
    """Anchors whole, cut at cores, and cut into single strings."""
    rows = rows_for(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bkt string, n_bytes int")
    got = remove_repeats(docs, size=size, bucket_bytes=3000, wide_buckets=wide, wide_segments=many, sort_bytes=6000)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, size)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_order():
    rng = random.Random(0)
    for _ in range(100):
        s = np.array([rng.randint(0, rng.choice([2, 20])) for _ in range(rng.randint(1, 300))], np.uint8)
        b, order = s.tobytes(), suffix_order(s, 32)
        assert sorted(order.tolist()) == list(range(len(s)))
        heads = [b[i : i + 32] for i in order]
        assert heads == sorted(heads)


def test_short_common_words_are_no_anchor():
    """Texts that have only words of 20 bytes in common share no anchor, so none of their segments travels."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=20)) for _ in range(12)]
    one, two = (np.frombuffer("".join(w + "".join(rng.choices(abc, k=6)) for w in rng.choices(words, k=2000)).encode(), np.uint8) for abc in ("ijklm", "nopqr"))
    assert not np.intersect1d(anchors(one, 50), anchors(two, 50)).size


def bucket_of(texts, size):
    return Bucket(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64())}), size)


@pytest.mark.parametrize("size", [16, 50, 200])
def test_cores_are_those_of_each_start(size):
    """Runs are cut where the least gram of their strings moves or lies on the other side of half a window."""
    texts = [t for i, t in rows_for(9) if t and i is not None]
    b = bucket_of(texts, size)
    cores, gram = b.cores(np.arange(len(b.start)), size), gram_bytes(size)
    h, window = grams(b.data, gram), size - gram + 1
    keys = {}
    assert cores.start.tolist() == sorted(cores.start.tolist()) and (cores.stop - cores.start).sum() == (b.stop - b.start).sum()
    for a, e, key in zip(cores.start.tolist(), cores.stop.tolist(), cores.key.tolist()):
        at = [s + int(h[s : s + window].argmin()) for s in range(a, e)]
        far = {p - s >= window // 2 for p, s in zip(at, range(a, e))}
        assert len(set(at)) == len(far) == 1
        c, n = (at[0] - window // 2, window // 2 + gram) if far == {True} else (at[0], size - window // 2 + 1)
        assert e - 1 <= c and c + n <= a + size  # every string of the stretch holds the core
        assert keys.setdefault((far == {True}, b.data[c : c + n].tobytes()), key) == key


def test_places_of_segments_are_packed():
    """The marking stage gets them back instead of looking for anchors again."""
    s = Segments(np.array([0, 7, 5_000_000, 3, 90]), np.array([0, 1, 1, 2, 0]), np.array([64, 1, 17]), np.array([70_000, 0, 70_000]))
    back = Segments.unpacked(s.packed())
    assert all(np.array_equal(getattr(s, c), getattr(back, c)) for c in ("begin", "seg", "starts", "rng"))
    assert [(r, own.tolist()) for r, own in back.by_range()] == [(0, [1]), (70_000, [0, 2])]
    assert back.least(np.array([9, 4, 2, 8, 5])).tolist() == [5, 2, 8]
    empty = Segments.unpacked(Segments(*[np.zeros(0, np.int64)] * 4).packed())
    assert list(empty.by_range()) == [] and len(empty.begin) == 0
    assert Bucket(pa.table({"doc_id": [1], "text": ["x" * 60], "n_bytes": [60]}), 50, runs=False).data.size == 60
