"""Registered queries on the smallest tables."""

import duckdb

from tidelore.plans import oracle, queries

SF = "/root/testdata/sf0.001"


def test_excerpts_hold_every_turn(spark):
    turns = {r["turn_id"]: r["content"] for r in queries._turns(spark, SF).collect()}
    got = {r["turn_id"]: r["excerpt"] for r in queries.excerpts(spark, SF).collect()}
    assert set(got) == set(turns)
    short = [i for i, t in turns.items() if len(t) <= 300]
    assert short and all(got[i] == turns[i] for i in short)


def test_merge_hits_equal_their_sql_where_ids_are_null(spark, tmp_path):
    # Few texts, so which row holds which number decides what is left out; too few rows for equal scores of one hit.
    rows = [(None if i % 37 == 5 else i // 4, None if i % 41 == 7 else i, "user", "same" if i % 3 else f"text {i % 400}") for i in range(4000)]
    at = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame([r for r in rows if r[0] is not None or r[1] is not None], "conv_id long, turn long, role string, text string").write.parquet(at)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{at}/*.parquet')")
    want = con.execute(oracle.sql()["merge_hits"]).fetchall()
    assert len(want) > 40
    assert sorted(tuple(r) for r in queries.merge_hits(spark, str(tmp_path)).collect()) == sorted(want)
