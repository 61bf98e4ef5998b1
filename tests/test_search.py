"""Merging of hits on small frames."""

import random
from fractions import Fraction

import numpy as np

from tidelore.functions.features import postings
from tidelore.operators.near import bands
from tidelore.operators.search import coverage, merge_hits, near_pairs

HITS = "query_id long, hit_type string, hit_id long, kind string, content string, source_turn_id long, score double"


def test_merge_keeps_the_earliest_of_equal_scores(spark):
    rows = [(0, "turn", 5, "USER", f"text {s}", s, 0.5) for s in range(40, 0, -1)] + [(0, "turn", 6, "USER", "text 1", 50, 0.25)]
    for parts in (1, 7):
        got = merge_hits(spark.createDataFrame(rows, HITS).repartition(parts, "source_turn_id"), 8).collect()
        assert [(h["hit_id"], h["source_turn_id"], h["rank"]) for h in got] == [(5, 1, 1)]


def _near(sets, least):
    sim = lambda a, b: len(a & b) / len(a | b)
    return {(i, k): round(sim(sets[i], sets[k]), 9) for i in sets for k in sets if i < k and sim(sets[i], sets[k]) >= least}


def test_near_pairs_are_all_pairs(spark):
    rng = random.Random(3)
    sets = {0: set()}
    for k in range(1, 160):
        near = set(sets[rng.randrange(k)]) if rng.random() < 0.6 else {f"term{rng.randint(0, 99)}" for _ in range(rng.randint(1, 40))}
        sets[k] = near if rng.random() < 0.3 else {t for t in near if rng.random() > 0.05} | {f"term{rng.randint(0, 99)}" for _ in range(rng.randint(0, 2))}
    docs = spark.createDataFrame([(k, " ".join(sorted(s))) for k, s in sets.items()], "id long, text string")
    held = {k: s for k, s in sets.items() if s}
    for least in (0.8, 0.45):
        got = near_pairs(docs, "id", "text", least=least).collect()
        assert len(got) == len({(r["a"], r["b"]) for r in got})
        assert {(r["a"], r["b"]): round(r["similarity"], 9) for r in got} == _near(held, least)


def test_terms_are_ranked_without_exchanging_them(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "beta gamma"), (2, "alpha")], "id long, text string")
    got = postings(docs, ["id"], "text", 9)
    assert sorted((r["id"], r["term"], r["weight"]) for r in got.collect()) == [(1, "alpha", 5.8), (1, "beta", 11.6), (1, "gamma", 5.8), (2, "alpha", 5.8)]
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_coverage_is_summed_where_documents_are_read(spark):
    rng = random.Random(4)
    posted = spark.createDataFrame([(kind, k, rng.sample([f"t{i}" for i in range(150)], rng.randint(0, 120))) for kind in ("turn", "attachment") for k in range(1100)], "hit_type string, hit_id long, terms array<string>").repartition(1)
    terms = spark.createDataFrame([(q, f"t{i}", float(i), i + 0.5) for q in range(3) for i in rng.sample(range(160), 30)], "query_id int, term string, weight double, idf_weight double")
    for kind in ("turn", "attachment", "entry"):
        one, other = ({(r["query_id"], r["hit_id"]): (round(r["exact"], 6), round(r["coarse"], 6)) for r in coverage(terms, posted, kind, small).collect()} for small in (True, False))
        assert one == other and bool(one) == (kind != "entry")
    assert "Exchange" not in coverage(terms, posted.coalesce(1).cache(), "turn", True)._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]


def test_near_pairs_compare_whole_texts(spark):
    rng = random.Random(5)
    head = {f"frequent{i}" for i in range(60)}
    sets = {k: head | {f"tail{rng.randint(0, 400)}" for _ in range(300)} for k in range(8)}
    for k in range(8, 20):
        sets[k] = {t for t in sets[k % 8] if rng.random() > 0.06 * (k % 3)} | {f"own{k}"}
    for k in range(20, 50):
        sets[k] = {f"{k}{t}" if rng.random() < 0.02 * (k - 20) else t for t in sets[0]}
    twice = lambda s: " ".join([t for t in sorted(s) for _ in range(1 + 8 * t.startswith("frequent"))])
    rows = [(k, twice(s)) for k, s in sets.items()] + [(50, twice(sets[0])), (51, None), (None, twice(sets[0]))]
    parts = [(52, " ".join(sorted(sets[1])[:200])), *rows, (52, " ".join(sorted(sets[1])[150:]))]
    docs = spark.createDataFrame(parts, "id long, text string")
    want = _near(sets | {50: sets[0], 52: sets[1]}, 0.8)
    assert 8 < len(want) < 500
    for n in (1, 6):
        got = near_pairs(docs.repartition(n), "id", "text").collect()
        assert len(got) == len(want) and {(r["a"], r["b"]): round(r["similarity"], 9) for r in got} == want


def test_bands_hold_all_partners():
    for t in (Fraction(4, 5), Fraction(9, 20), Fraction(1, 2), Fraction(99, 100)):
        edges = bands(3000, t)
        of = lambda n: int(np.searchsorted(edges, n, "right"))
        for n in range(1, 3000):
            assert of(min(3000, int(n / t))) - of(n) in (0, 1)
