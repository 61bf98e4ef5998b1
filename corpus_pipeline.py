"""The corpus pipeline: each stage works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelore.llm import jaccard, mixing, packing, pii, toxicity
from tidelore.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text the nearest-example score rejects go (predicted 1); all others stay, null ids and empty texts too."""
    return toxicity.score_rows(docs, table(spark, sf_dir, "labels")).filter("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the smallest id (five words, similarity 0.8); of rows
    that repeat both id and text, one. Rows that share only their id are documents of their own. Null ids stay."""
    rows = materialize(docs.withColumn("_row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "rows")
    copies = jaccard.jaccard_components(rows, words=5, num=80, den=100, id_col="_row").filter("component_id <> doc_id").select(F.col("doc_id").alias("_row"), "component_id")
    members = materialize(copies.unionByName(copies.select(F.col("component_id").alias("_row"), "component_id").distinct()).join(rows.select("_row", "doc_id"), "_row"), "members")
    stay = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("m")).select(F.col("m._row").alias("_row"))
    kept = rows.join(members.join(stay, "_row", "left_anti").select("_row"), "_row", "left_anti").select(*docs.columns)
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.filter("doc_id is null"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes its kind in brackets; n_chars follows the text."""
    out = pii.mask_pii(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as the mix takes them: left out, once, or twice."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Nearest examples, masking and tokens are not SQL; the operators of the stages are tested in tests/llm.
ORACLE_SQL = None
