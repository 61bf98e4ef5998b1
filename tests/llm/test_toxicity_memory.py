"""What a worker holds of the examples, and how texts reach it."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tidelore.llm import toxicity


def test_index_is_built_in_little_memory():
    """Every worker builds the index: doing so takes less than half as much again as the index itself, whose postings are small numbers."""
    rng = np.random.default_rng(3)
    n, terms, each = 2000, 20000, 400
    row = np.repeat(np.arange(n, dtype=np.int32), each)
    drawn = (terms * rng.random((n, each)) ** 3).astype(np.int32)
    row, term = np.unique(row.astype(np.int64) * terms + drawn.ravel()).astype(np.int64) // terms, np.unique(row.astype(np.int64) * terms + drawn.ravel()) % terms
    row, term, tf, scale = row.astype(np.int32), term.astype(np.int32), np.ones(len(term), np.uint8), np.ones(terms)
    tracemalloc.start()
    try:
        ix = toxicity.Index(np.arange(n), np.arange(n) % 2, (row, term, tf), scale, (n / 2, n / 2))
        held, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert most < 1.5 * held and ix.rows.dtype.itemsize == 2
    near = ix.nearest(np.zeros((row == 7).sum(), int), term[row == 7], tf[row == 7], 1, 3)
    assert ix.ids[near[0][0][0]] == 7 and abs(near[0][1][0] - 1) < 1e-6


def test_counts_go_once_the_index_is_built():
    """The examples' counts serve to build the index only; small counts take one byte each, and weigh as any others."""
    terms, tf = np.array([0, 1, 1, 2, 0, 2], np.int32), np.array([200, 1, 2, 3, 9, 1], np.uint8)
    ex = toxicity.Examples(np.array([5, 8, 9]), np.array([0, 1, 1]), np.array([2, 2, 2], np.int32), terms, tf, np.array([1.0, 2.0, 3.0]), (1.0, 2.0))
    ix = ex.index()
    assert ex.terms is None and ex.tf is None and ex.index() is ix
    assert ix.ids[ex.places(np.array([9, 5, 8]))].tolist() == [9, 5, 8]
    wide = toxicity.Index(ex.ids, ex.y, (np.repeat([0, 1, 2], 2), terms, tf.astype(float)), ex.scale, ex.totals)
    assert np.array_equal(ix.dense, wide.dense) and np.array_equal(ix.values, wide.values) and np.array_equal(ix.ids, wide.ids)


def test_text_travels_once(spark):
    """A text column goes to the workers within its row only; texts of another type are still scored as strings."""
    rows = [(i, f"word{i % 7} thing{i % 5}" + " vileword" * (i % 3 == 0)) for i in range(90)] + [(200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    scored = toxicity.score_rows(docs, labels)
    plan = scored._jdf.queryExecution().analyzed().toString()
    sent = next(x for x in plan.splitlines()[::-1] if "Project" in x and "AS row" in x)
    assert " AS text" not in sent
    other = toxicity.score_rows(docs.withColumn("text", F.encode("text", "utf-8")), labels)
    got = [{r["row"]["doc_id"]: r["score"] for r in d.collect()} for d in (scored, other)]
    assert len(got[0]) == 91 and got[0] == got[1]
