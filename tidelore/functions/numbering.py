"""Consecutive numbers over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..durable import stored


def numbered(df: DataFrame, order: list, out: str, after: int = 0) -> DataFrame:
    """Adds `out`: after + 1, after + 2, .. in the given order.

    Rows are dealt to ranges of the order and sorted there; the rows before each range (one number per partition) are
    then added. Rows with equal order get any order among themselves, the same in every later read.
    """
    spark = df.sparkSession
    dealt = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row per partition
    ahead, rows = after, []
    for p in sorted(counts):
        rows.append((p, ahead))
        ahead += counts[p]
    offsets = F.broadcast(spark.createDataFrame(rows, "_part long, _ahead long"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(offsets, part == F.col("_part")).withColumn(out, F.col("_ahead") + place + 1).drop("_at", "_part", "_ahead")
