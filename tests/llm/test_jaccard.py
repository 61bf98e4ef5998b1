"""N-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest

from tidelore.llm import shingles as shingles_module
from tidelore.llm.components import components
from tidelore.llm.jaccard import jaccard_components
from tidelore.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def rows_for(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 4))) for _ in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = []
    for _ in range(12):
        base = say(rng.choice([6, 20, 90, 200, 400]))
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1, 1])] = say(rng.choice([0, 1, 2]))
            rows.append(" ".join(w) + rng.choice(["", "\n", " \t"]))
    chain = say(120)
    for k in range(20):  # neighbours link, ends don't
        rows.append(" ".join(chain[k * 2 :] + say(0) + [f"n{j}" for j in range(k * 2)]))
    passage = say(40)
    rows += [" ".join(say(60) + passage) for _ in range(15)]
    rows += ["A b", "a B", "a b c d e", "A B C D E", "", "  \n", None, "x", "X"]
    ids = rng.sample(range(1000), len(rows))
    out = list(zip(ids, rows))
    out += [out[0], (out[1][0], out[5][1]), (None, rows[0])]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,n,num", [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_components_equal_brute_force(spark, seed, n, num):
    rows = rows_for(seed)
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, component string, n int")
    got = jaccard_components(docs, n, num, 100, bucket_bytes=20_000)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, n, num, 100)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shingle_counts():
    texts = ["", "a", "a b c d", "a b c d e", " a  b\tc\rd ", "é b c d e f", "a b c d a b c d a b c d", "A b"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    h, at = shingle_sets(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]), 4)
    assert np.diff(at).tolist() == [len(shingles(t, 4)) for t in texts]
    assert h[at[2]] == h[at[4]]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    for a, b in edges:
        if a != b:
            assert got[a] == got[b] <= min(a, b)
    assert len(set(got.values())) == len({got[v] for v in set(got.values())})


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["a", "bcd", "é" * 9, "x" * 150, "\n", "word"], k=rng.randint(0, 90))).encode() for _ in range(40)]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = shingle_sets(data, off, 3)
    monkeypatch.setattr(shingles_module, "CHUNK", 64)
    shingles_module._usual_powers.cache_clear()
    cut = shingle_sets(data, off, 3)
    shingles_module._usual_powers.cache_clear()
    assert [x.tolist() for x in whole] == [x.tolist() for x in cut]
