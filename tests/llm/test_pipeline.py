"""Stages of the corpus pipeline on small tables."""

import corpus_pipeline


def test_near_duplicates_go_by_row(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, one, "s"), (1, three, "s"), (2, one, "s"), (2, two, "s"), (3, two + " end", "s"), (4, "", "s"), (4, "", "s"), (5, one, "s"), (5, one, "s"), (None, one, "s"), (None, one, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    want = [(1, one), (1, three), (2, two), (4, ""), (None, one), (None, one)]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").collect() == []


def test_smallest_id_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, text) for i in (9, 3, 7, 2, 8)], "doc_id long, text string").repartition(3)
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()] == [2]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated ids and clashing columns through every stage; each stage against what it must keep."""
    good = [" ".join(f"word{(i * 7 + j) % 90}" for j in range(30)) for i in range(40)]
    bad = [f"{t} vileword nastyish" for t in good]
    rows = [(i, good[i] if i % 2 else bad[i], "en", "ab"[i % 3 > 0], 1.0, "x") for i in range(40)]
    rows += [(1, bad[1], "en", "a", 1.0, "x"), (100, None, None, None, None, None), (101, "", "en", "a", 0.0, "x"), (None, "mail a.b@c.de now please", "en", "b", 0.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, row string")
    spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(texts, key=str) == sorted([(i, good[i]) for i in range(1, 40, 2)] + [(100, None), (101, ""), (None, rows[-1][1])], key=str)
    masked = corpus_pipeline.mask_personal_data(spark, kept, "")
    assert masked.columns == docs.columns and {r["text"] for r in masked.filter("doc_id is null").collect()} == {"mail [EMAIL] now please"}
    mixed = corpus_pipeline.mix_sources(spark, masked, "").collect()
    assert 0 < len(mixed) <= 2 * len(texts) and all((r["doc_id"], r["text"]) in texts or r["doc_id"] is None for r in mixed)
    packed = corpus_pipeline.pack_sequences(spark, masked, "").collect()
    assert len(packed) == len(texts) and sum(r["length"] == 1 for r in packed) == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
