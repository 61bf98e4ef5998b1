"""The fold of the dictionary against the plain rule, and its time."""

import random
import time

from tidelore.operators import dictionary

ATOMS = "turn_id long, role string, rank int, kind string, content string, confidence double"


def plain(atoms):
    """atoms: (turn_id, authority, fingerprint, {term: tenths}); every active entry is compared."""
    made, out = [], []
    for turn, authority, mark, own in atoms:
        hit = next((m for m in made if m["active"] and m["mark"] == mark), None)
        old = None
        if hit is None and own:
            weight = lambda m: sum(w for t, w in own.items() if t in m["terms"])
            near = sorted((m for m in made if m["active"] and weight(m)), key=lambda m: (-weight(m), -m["n"]))[: dictionary.CANDIDATES]
            sim = lambda m: len(m["terms"] & own.keys()) / len(m["terms"] | own.keys())
            best = max(near, key=sim, default=None)  # the first of equal ones
            if best is not None and sim(best) >= dictionary.SIMILAR:
                if authority >= best["authority"]:
                    best["active"], old = False, best
                else:
                    hit = best
        if hit is None:
            made.append({"n": len(made), "turn": turn, "authority": authority, "mark": mark, "terms": set(own), "active": True, "version": 1 + (old["version"] if old else 0)})
        out.append(("link", hit["turn"], None, None) if hit else ("insert", turn, made[-1]["version"], old["turn"] if old else None))
    return out, {m["turn"]: "active" if m["active"] else "superseded" for m in made}


def test_fold_follows_the_plain_rule(spark):
    rng = random.Random(5)
    rows = []
    for turn in range(700):
        words = rng.sample([f"w{k}xyz" for k in range(9)], rng.randint(1, 9)) if turn % 3 else [f"u{rng.randint(0, 30)}abc", *rng.choices(["alpha", "bravo", "delta"], k=5)]
        rows.append((turn, rng.choice(["user", "assistant", "tool"]), 1, "FACT", " ".join(words), 0.5))
    rows.append((700, "user", 1, "FACT", "a", 0.5))
    atoms = spark.createDataFrame(rows, ATOMS)
    terms = {r["turn_id"]: {t["term"]: t["tenths"] for t in r["terms"]} for r in dictionary.with_terms(atoms).collect()}
    want, status = plain([(r[0], {"user": 1.0, "assistant": 0.72, "tool": 0.55}[r[1]], r[4], terms[r[0]]) for r in rows])
    got = {r["turn_id"]: r for r in dictionary.fold(atoms).collect()}
    assert [(got[t]["event"], got[t]["target_turn"], got[t]["version"], got[t]["old_turn"]) for t in range(701)] == want
    assert {t: r["status"] for t, r in got.items() if r["event"] == "insert"} == status
    assert {"link", "insert"} == {w[0] for w in want} and "superseded" in status.values()


def test_fold_of_frequent_words_is_fast(spark):
    rows = [(k, "user", 1, "FACT", f"common words stand inside every sentence own{k} mark{k} sign{k}", 0.5) for k in range(20000)]
    began = time.time()
    got = dictionary.fold(spark.createDataFrame(rows, ATOMS)).groupBy("event").count().collect()
    assert [(r["event"], r["count"]) for r in got] == [("insert", 20000)]
    assert time.time() - began < 60
