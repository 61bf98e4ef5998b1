"""Counted features and sentence rules against the expressions that they stand for."""

import random

from pyspark.sql import functions as F

from tidelore.functions import constants as K
from tidelore.functions.features import distinct_features, feature_rows, heaviest, term_lists, text_terms
from tidelore.functions.text import any_cue, has_anchor, strong_anchors
from tidelore.operators import extract

PARTS = ["a", "it", "the", "Abc", "word", "X-", "a.b", "v2_", "..HTTP", "é", "K", "İx", "'q uote'", "\"  \"", "“full text”", "存", "的", "项目叫做长卷", "我们需要测试", "可以", "一下", "。", "、", ".", "-", "#", "@x", "12", "\n", "?", "能不能"]


def _texts(n):
    rng = random.Random(8)
    return [None, "", *["".join(rng.choice(PARTS) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 9))) for _ in range(n)]]


def test_counted_features_are_those_of_the_expression(spark):
    d = spark.createDataFrame(list(enumerate(_texts(600))), "id long, text string")
    names = F.array_distinct(F.transform(feature_rows(F.col("text")), lambda f: f["term"]))
    for r in d.select("text", feature_rows(F.col("text")).alias("f"), F.size(names).alias("n"), distinct_features(F.col("text")).alias("m")).collect():
        want = {}
        for f in r["f"] or []:
            want[f["term"]] = want.get(f["term"], 0) + f["tenths"]
        assert text_terms(r["text"]) == want, r["text"]
        assert heaviest(want, 3) == sorted(want.items(), key=lambda x: (-x[1], -len(x[0]), x[0]))[:3]
        assert r["text"] is None or r["n"] == r["m"], r["text"]


def test_anchors_and_cues_are_seen_without_listing_them(spark):
    d = spark.createDataFrame([(t,) for t in _texts(900)[1:]], "text string")
    cues = "|".join(c for _, _, c in K.USER_CUES)
    low = F.lower("text")
    got = d.select("text", (F.size(strong_anchors(F.col("text"))) > 0).alias("a"), has_anchor(F.col("text")).alias("b"), low.rlike(cues.replace(".", r"\.")).alias("c"), any_cue(low, cues).alias("d")).collect()
    assert {r["a"] for r in got} == {r["c"] for r in got} == {True, False}
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in got)


def test_term_lists_merge_rows_of_one_key(spark):
    rows = [(1, "a", "alpha beta"), (1, "a", "beta"), (None, "a", "beta"), (None, "a", "beta"), (2, None, ""), (3, "b", None)]
    got = term_lists(spark.createDataFrame(rows, "k long, s string, text string").repartition(5), ["k", "s"], "text", 9).collect()
    assert sorted([(r["k"], r["s"], [tuple(t) for t in r["terms"]]) for r in got], key=str) == [(1, "a", [("beta", 2 * K.LATIN_LONG), ("alpha", K.LATIN_LONG)]), (None, "a", [("beta", 2 * K.LATIN_LONG)])]


def test_each_sentence_is_ruled_once(spark):
    turns = spark.createDataFrame([(1, "user", "We decided that the plan of version two holds.")], "turn_id long, role string, content string")
    plan = extract.atoms(turns, ["turn_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("we decided") == 1 and plan.count("RepartitionByExpression") == 1
