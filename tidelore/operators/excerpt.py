"""The most useful sentences of long texts for their queries, as a top-k and a running sum over sentence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import constants as K
from ..functions.features import postings, query_features
from ..functions.text import anchor_ratio, any_cue, sentences, strong_anchors

SENTENCES = 4
#: Features of a sentence that count; a cut sentence keeps more than CUT_CHARS characters or goes.
SENTENCE_TERMS, CUT_CHARS = 72, 40


def _bonus(low_query: Column, low_sentence: Column) -> Column:
    total = F.lit(0.0)
    for cues, pattern, bonus in K.EXCERPT_BONUSES:
        asked = any_cue(low_query, cues) if cues else F.lit(True)
        total = total + F.when(asked & low_sentence.rlike(pattern), bonus).otherwise(0.0)
    return total


def excerpts(texts: DataFrame, keys: list[str], queries: DataFrame, max_chars: int | str = 900, most: int = SENTENCES) -> DataFrame:
    """Adds `excerpt` to texts (keys, query_id, content); queries (query_id, query) and contents are normalised.

    A text of at most `max_chars` (a number or the name of a column) stays whole. Of a longer one the `most` best sentences
    remain in their order: each scores by the query's weight that its features cover, by the query's anchors in it and
    by cues; they are taken while they fit, the first that does not is cut. Without sentences the text's head remains.
    Rows with equal keys must have equal contents.
    """
    room = F.lit(max_chars) if isinstance(max_chars, int) else F.col(max_chars)
    own = [*dict.fromkeys([*keys, "query_id"])]
    long = texts.filter(F.length("content") > room).select(*own, "content", room.alias("_max")).dropDuplicates(keys)
    rows = long.select(*own, "_max", F.posexplode(sentences(F.col("content"))).alias("_pos", "_s"))
    terms = query_features(queries, ["query_id"], "query")
    asked = queries.select("query_id", F.lower("query").alias("_q"), strong_anchors(F.col("query")).alias("_anchors"))
    asked = asked.join(terms.groupBy("query_id").agg(F.sum("weight").alias("_all")), "query_id", "left")
    have = postings(rows.select(*own, "_pos", "_s"), [*own, "_pos"], "_s", SENTENCE_TERMS)
    covered = have.select(*own, "_pos", "term").join(terms, ["query_id", "term"]).groupBy(*keys, "_pos").agg(F.sum("weight").alias("_met"))
    rows = rows.join(asked, "query_id").join(covered, [*keys, "_pos"], "left")
    share = F.coalesce(F.try_divide(F.col("_met"), F.col("_all")), F.lit(0.0))
    named = F.when(F.size("_anchors") > 0, 0.25 + 1.75 * anchor_ratio(F.col("_anchors"), F.col("_s"))).otherwise(1.0)
    rows = rows.withColumn("_score", F.round(share * named + _bonus(F.col("_q"), F.lower("_s")), 9))
    best = rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_score"), "_pos"))).filter(F.col("_r") <= most)
    # Ends of the sentences in the joined text; at most one of them is cut.
    upto = W.partitionBy(*keys).orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    best = best.withColumn("_end", F.sum(F.length("_s") + 1).over(upto) - 1)
    begin = F.greatest(F.lit(0), F.col("_end") - F.length("_s") - 1)
    left = F.col("_max") - begin
    piece = F.when(F.col("_end") <= F.col("_max"), F.col("_s")).when((begin <= F.col("_max")) & (left > CUT_CHARS), F.concat(F.substring(F.col("_s"), F.lit(1), (left - 3).cast("int")), F.lit("...")))
    kept = best.withColumn("_piece", piece).filter("_piece is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_piece"))).alias("_kept"))
    kept = kept.select(*keys, F.array_join(F.transform("_kept", lambda k: k["_piece"]), "\n").alias("_short"))
    head = F.concat(F.substring(F.col("content"), F.lit(1), (room - 3).cast("int")), F.lit("..."))
    out = texts.join(kept, keys, "left")
    return out.withColumn("excerpt", F.when(F.length("content") <= room, F.col("content")).otherwise(F.coalesce("_short", head))).drop("_short")
