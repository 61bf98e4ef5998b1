"""Empty tables, nulls, repeated rows and clashing columns, operator by operator."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidelore.llm import chat, flat_tokens, hilbert, mixing, pii, segments
from tidelore.llm.queries import OP3_SQL

VECTORS = "vec_id long, embedding array<float>, rank int, score double"
MESSAGES = "conv string, node string, parent string, role string, text string, score double"


def test_products_of_repeated_ids_equal_sql(spark):
    x = np.random.default_rng(3).standard_normal((120, 8)).round(1).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(120)]
    rows += [(7, x[9].tolist()), (7, x[7].tolist()), (50, x[11].tolist()), (50, x[50].tolist()), (100, None), (101, [float("nan")] * 8), (None, x[0].tolist()), (102, [None] + [1.0] * 7), (-50, [0.0] * 8)]
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))}))
    want = sorted(con.execute(OP3_SQL).fetchall())
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], VECTORS).repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in segments.top_products(df, 50, 5).collect())
    assert got == want and len(got) == 20


@pytest.mark.parametrize("search", [segments.top_products, hilbert.nearest])
def test_vector_search_of_few_rows(spark, search):
    assert search(spark.createDataFrame([], VECTORS), 50, 5).collect() == []
    assert search(spark.createDataFrame([(0, [1.0, 2.0], 1, 0.0)], VECTORS), 50, 5).collect() == []
    two = search(spark.createDataFrame([(0, [1.0, 2.0], 1, 0.0), (1, [1.0, 0.0], 1, 0.0), (2, None, 1, 0.0)], VECTORS), 50, 5).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in two] == [(0, 1, 1)]


def test_pii(spark):
    schema = "doc_id long, text string, spans string, n_email long, kind string"
    assert pii.detect_pii(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None, "s", 9, "k"), (1, "", "s", 9, "k"), (None, "a.b@c.de", "s", 9, "k"), (2, "x" * 300_000 + " 10.0.0.1", "s", 9, "k")]
    docs = spark.createDataFrame(rows, schema)
    got = {(r["doc_id"], r["n_email"], r["n_ip"]) for r in pii.detect_pii(docs).collect()}
    assert got == {(1, 0, 0), (None, 1, 0), (2, 0, 1)}
    masked = pii.mask_pii(docs)
    assert masked.columns == docs.columns and masked.filter("doc_id = 1 and text is null").count() <= 1
    assert pii.detect_pii(docs).count() == 4


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, node string, path_rank int"
    assert chat.format_conversations(chat.linear_messages(spark.createDataFrame([], schema))).collect() == []
    rows = [(None, 0, "user", "a", "n", 1), (None, 1, "assistant", None, "n", 1), (3, 0, None, "b", "n", 1), (3, 0, None, "b", "n", 1)]
    got = chat.format_conversations(chat.linear_messages(spark.createDataFrame(rows, schema))).select("n_turns", chat.read_back(chat.F.col("formatted")).alias("back")).collect()
    assert sorted([tuple(t) for t in r["back"]] for r in got) == [[("", "b"), ("", "b")], [("user", "a"), ("assistant", "")]]
    assert chat.format_conversations(spark.createDataFrame([], MESSAGES)).collect() == []


def test_token_counts(spark):
    schema = "doc_id long, text string, file string, block int, ids binary, start long"
    assert flat_tokens.count_documents(flat_tokens.write_flat(spark.createDataFrame([], schema))).collect() == []
    docs = spark.createDataFrame([(None, "a", "f", 1, None, 0), (4, "", "f", 1, None, 0), (4, None, "f", 1, None, 0), (4, "b " * 100_000, "f", 1, None, 0)], schema)
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in flat_tokens.count_documents(flat_tokens.write_flat(docs)).collect()), key=str)
    assert [g for g in got if g[1] <= 1] == [(4, 0), (4, 0), (None, 1)] and len(got) == 4


def test_mixing(spark):
    schema = "doc_id long, text string, source string, size long, shard int, taken double, block int"
    none = spark.createDataFrame([], schema)
    assert mixing.mix(none).collect() == [] and mixing.apply_mix(none).collect() == []
    rows = [(1, "a b c", "s", 0, 0, 0.0, 0)] * 3 + [(None, "a b", None, 0, 0, 0.0, 0)] * 3 + [(2, None, "s", 0, 0, 0.0, 0), (3, " ", "t", 0, 0, 0.0, 0)]
    got = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 2, 3, 3, 3]
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = {r["source"]: r["target"] for r in got}
    for s, target in by.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target) <= 1


def test_mixed_rows_keep_columns_and_sources(spark):
    """Clashing columns stay as they were; rows with one id in two sources take what their own source takes."""
    schema = "doc_id long, text string, source string, taken double, n int, words string, row string, copies int, _n int"
    rows = [(None if i % 3 else i, " ".join(f"w{i}" for _ in range(10)), "abc"[i % 3], 0.5, 4, "z", "r", 7, 8) for i in range(600)]
    docs = spark.createDataFrame(rows, schema)
    got = mixing.apply_mix(docs).collect()
    assert mixing.apply_mix(docs).columns == docs.columns
    assert {tuple(r)[3:] for r in got} == {(0.5, 4, "z", "r", 7, 8)} and {(r["doc_id"], r["text"], r["source"]) for r in got} <= {r[:3] for r in rows}
    targets = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    assert all(abs(10 * sum(r["source"] == s for r in got) - t) <= 0.15 * t for s, t in targets.items())
