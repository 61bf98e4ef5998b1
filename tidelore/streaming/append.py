"""Live appends: JSON lines arrive as files and go through the store's batch append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..store import Store

LINES = "session_id string, role string, content string, created_at string, extract boolean"


def stream_append(spark: SparkSession, source: str, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Follows a folder of JSON lines. Files are taken one per batch, oldest first, and batches run one after another, so
    ids follow arrival; the store's hash check makes a replayed batch add nothing."""
    lines = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).json(source)

    def add(batch: DataFrame, _: int) -> None:
        items = batch.select(F.coalesce("session_id", F.lit("main")).alias("session_id"), F.monotonically_increasing_id().alias("pos"), "role", "content", "created_at", F.coalesce("extract", F.lit(True)).alias("extract"))
        store.append(items)

    writer = lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
