"""Ranked retrieval for a batch of queries over turns, entries and attachments.

Postings join query terms on the term; query sides are small and are broadcast only below a checked size. A
document's coarse score uses its few heaviest terms (what its sketch holds), its exact score more of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..durable import stored
from ..functions import constants as K
from ..functions.features import query_features, term_lists, term_sets
from ..functions.text import anchor_factor, any_cue, looked_up, normalize_text, strong_anchors, with_normalized
from .excerpt import excerpts
from .near import near_sets

#: Terms of a document that count for its coarse and its exact score.
COARSE = {"turn": 64, "entry": 48, "attachment": 96}
EXACT = {"turn": 128, "entry": 96, "attachment": 128}
BROADCAST_ROWS = 200_000
#: Documents and pairs of query and document that one sum holds at once.
DOCS_AT_ONCE, CELLS_AT_ONCE = 512, 4 << 20
_COVERED = "query_id {}, hit_id long, exact double, coarse double"
EXCERPT_CHARS = {"turn": 820, "attachment": 800}


def all_postings(turns: DataFrame, entries: DataFrame, attachments: DataFrame) -> DataFrame:
    """(hit_type, hit_id, terms) over the three tables (hit_id, text): each one's terms by rank, in one row."""
    parts = [term_lists(t.select("hit_id", "text"), ["hit_id"], "text", EXACT[kind]).select(F.lit(kind).alias("hit_type"), "hit_id", F.transform("terms", lambda x: x["term"]).alias("terms")) for kind, t in (("turn", turns), ("entry", entries), ("attachment", attachments))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _coarse() -> Column:
    return F.col("rank") <= F.element_at(F.create_map(*[F.lit(x) for kv in COARSE.items() for x in kv]), F.col("hit_type"))


def idf_query_terms(base: DataFrame, posted: DataFrame, n_docs: int) -> DataFrame:
    """(query_id, term, weight, idf_weight): rarer terms weigh up to twice; terms in no document are left out."""
    df = posted.filter(_coarse()).join(base.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return base.join(df, "term").withColumn("idf_weight", F.col("weight") * (1 + F.greatest(F.lit(0.0), (F.lit(n_docs) - F.col("df")) / F.lit(max(1, n_docs)))))


def coverage(terms: DataFrame, posted: DataFrame, kind: str, small: bool) -> DataFrame:
    """(query_id, hit_type, hit_id, coarse, exact): the query's weight that the terms of each document of a kind have, where
    coarse is above 0. If the query side is small, each document's sums are made where its row is read."""
    own = "weight" if kind == "attachment" else "idf_weight"
    docs = posted.filter(F.col("hit_type") == kind).select("hit_id", "terms")
    if not small:
        met = terms.join(docs.select("hit_id", F.posexplode("terms").alias("_p", "term")), "term")
        sums = met.groupBy("query_id", "hit_id").agg(F.sum(own).alias("exact"), F.sum(F.when(F.col("_p") < COARSE[kind], F.col(own)).otherwise(0.0)).alias("coarse"))
        return sums.filter("coarse > 0").withColumn("hit_type", F.lit(kind))
    rows = terms.select("query_id", "term", own).orderBy("term", "query_id").toArrow()  # at most BROADCAST_ROWS
    if not rows.num_rows:
        return terms.sparkSession.createDataFrame([], _COVERED.format(terms.schema["query_id"].dataType.simpleString())).withColumn("hit_type", F.lit(kind))
    dealt = rows["query_id"].combine_chunks().dictionary_encode()
    names, ids, at, weight = pc.unique(rows["term"]), dealt.dictionary, dealt.indices.to_numpy(), rows[own].to_numpy()
    first = np.r_[0, np.cumsum(np.bincount(pc.index_in(rows["term"], names).to_numpy(), minlength=len(names)))]
    limit, n_q = COARSE[kind], len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch["terms"]), 0).to_numpy(zero_copy_only=False)
            code = pc.fill_null(pc.index_in(pc.list_flatten(batch["terms"]), names), -1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            step = max(1, min(DOCS_AT_ONCE, CELLS_AT_ONCE // n_q))
            for a in range(0, len(size), step):
                n, lo = len(size[a : a + step]), ends[a] - size[a]
                mine = code[lo : ends[min(a + step, len(size)) - 1]]
                doc = np.repeat(np.arange(n), size[a : a + step])
                rank = np.arange(len(mine)) - (ends - size)[a : a + step][doc] + lo
                doc, rank, mine = doc[mine >= 0], rank[mine >= 0], mine[mine >= 0]
                per = first[mine + 1] - first[mine]
                idx = np.repeat(first[mine], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                cell, w = np.repeat(doc, per) * n_q + at[idx], weight[idx]
                exact = np.bincount(cell, w, n * n_q)
                coarse = np.bincount(cell, np.where(np.repeat(rank, per) < limit, w, 0.0), n * n_q)
                hit = np.flatnonzero(coarse > 0)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(hit % n_q)), batch["hit_id"].take(pa.array(a + hit // n_q)), pa.array(exact[hit]), pa.array(coarse[hit])], names=["query_id", "hit_id", "exact", "coarse"])

    return docs.mapInArrow(run, _COVERED.format(terms.schema["query_id"].dataType.simpleString())).withColumn("hit_type", F.lit(kind))


def score_hits(queries: DataFrame, turns: DataFrame, entries: DataFrame, attachments: DataFrame, posted: DataFrame | None = None, limit: int = 8, shorten: bool = True, kinds: tuple[str, ...] = ("entry", "attachment", "turn")) -> DataFrame:
    """All hits before merging, of `kinds` (terms are weighed over all tables all the same): query_id, hit_type, hit_id, kind, content, source_turn_id, score. Queries are folded by
    NFKC like stored turns. Contents of turns and attachments are excerpts, or whole texts if `shorten` is false.

    queries (query_id, query); turns (turn_id, session_id, seq, role, content); entries (entry_id, kind, content, authority,
    confidence, source_turn_id) that are active; attachments (attachment_id, filename, mime_type, media_type, sidecar_text,
    source_turn_id).
    """
    q = with_normalized(queries.select("query_id", F.col("query").alias("_raw")), "_raw", "query").select("query_id", "query")
    attached = lambda d: d.select(F.col("attachment_id").alias("hit_id"), F.concat_ws(" ", "filename", "mime_type", "media_type", "sidecar_text").alias("text"), F.upper("media_type").alias("kind"), "source_turn_id")
    at = attached(attachments)
    t = turns.select(F.col("turn_id").alias("hit_id"), F.col("content").alias("text"))
    e = entries.select(F.col("entry_id").alias("hit_id"), F.col("content").alias("text"))
    if posted is None:
        posted = stored(all_postings(t, e, at), "postings")
    rows = posted.select("hit_type", "hit_id", F.posexplode("terms").alias("rank", "term")).withColumn("rank", F.col("rank") + 1)
    base = stored(query_features(q, ["query_id"], "query"), "features")
    n_docs = turns.count() + entries.count() + attachments.count()
    terms = stored(idf_query_terms(base, rows, n_docs), "terms")
    small = terms.count() <= BROADCAST_ROWS
    sent = F.broadcast if small else lambda df: df
    totals = base.groupBy("query_id").agg(F.sum("weight").alias("plain")).join(terms.groupBy("query_id").agg(F.sum("idf_weight").alias("total")), "query_id")
    anchors = q.withColumn("anchors", strong_anchors(F.col("query"))).select("query_id", "anchors", any_cue(F.lower("query"), K.ANSWER_CUES).alias("asks"))
    of_query = stored(totals.join(anchors, "query_id"), "queries")

    def cov(kind: str) -> DataFrame:
        total = F.col("plain" if kind == "attachment" else "total")
        return coverage(terms, posted, kind, small).join(sent(of_query), "query_id").withColumn("coarse", F.col("coarse") / total).withColumn("exact", F.col("exact") / total).filter("coarse > 0").drop("plain", "total")

    out = ["query_id", "hit_type", "hit_id", "kind", "content", "source_turn_id", "score"]
    best = lambda d, n, *order: d.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("_r") <= n)

    max_entry = entries.agg(F.coalesce(F.max("entry_id"), F.lit(1)).alias("max_entry"))
    eh = cov("entry").join(entries, F.col("hit_id") == F.col("entry_id")).crossJoin(F.broadcast(max_entry))  # one row
    eh = eh.withColumn(
        "score",
        (0.18 * F.col("coarse") + 0.82 * F.col("exact"))
        * looked_up(F.col("kind"), K.KIND_BOOST, 1.0)
        * (0.62 + 0.28 * F.col("authority") + 0.10 * F.col("confidence"))
        * anchor_factor(F.col("anchors"), F.col("content"))
        * (1 + 0.04 * F.col("entry_id") / F.col("max_entry")),
    )
    eh = best(eh.filter("score > 0"), max(3 * limit, 18), F.desc("score"), F.desc(F.coalesce("source_turn_id", F.lit(0))), F.desc("hit_id")).select(*out)
    if kinds == ("entry",):
        return eh

    # The best ids first, then their texts, then the best rows where ids repeat.
    ah = cov("attachment").withColumn("score", 0.25 * F.col("coarse") + 0.75 * F.col("exact"))
    ah = stored(best(ah, max(limit, 5), F.desc("score"), F.desc("hit_id")).select("query_id", "hit_type", "hit_id", "score"), "attachments")
    # Only texts that are found are made again.
    ids = sent(ah.select(F.col("hit_id").alias("attachment_id")).distinct())
    ah = sent(ah).join(attached(attachments.join(ids, "attachment_id", "left_semi")).withColumnRenamed("text", "content"), "hit_id")
    ah = best(ah, max(limit, 5), F.desc("score"), F.desc("hit_id")).select(*out)

    max_turn = turns.agg(F.coalesce(F.max("turn_id"), F.lit(1)).alias("max_turn"))
    width = max(3 * limit, 18)
    th = cov("turn").crossJoin(F.broadcast(max_turn)).withColumn("coarse", F.col("coarse") * (1 + 0.04 * F.col("hit_id") / F.col("max_turn")))  # one row
    th = best(th, max(32, 8 * width), F.desc("coarse"), F.desc("hit_id")).drop("_r")
    reply = next_assistant(turns)
    th = th.join(turns.select(F.col("turn_id").alias("hit_id"), "role", "content"), "hit_id")
    th = th.withColumn("score", (0.12 * F.col("coarse") + 0.88 * F.col("exact")) * anchor_factor(F.col("anchors"), F.col("content")) * F.when(F.col("role") == "user", 1.05).otherwise(1.0))
    own = stored(th.filter("score > 0").withColumn("kind", F.upper("role")).withColumn("source_turn_id", F.col("hit_id")).select(*out, "role", "asks"), "turns")
    asked = own.filter("asks and role = 'user'").select("query_id", "hit_id", F.col("score").alias("asked_score")).join(reply, F.col("hit_id") == F.col("turn_id")).select("query_id", "asked_score", F.col("reply_id").alias("hit_id"))
    asked = stored(asked, "asked")
    answers = (
        asked.join(turns.select(F.col("turn_id").alias("hit_id"), "content"), "hit_id")
        .join(cov("turn").select("query_id", "hit_id", "exact").join(sent(asked.select("query_id", "hit_id").distinct()), ["query_id", "hit_id"], "left_semi"), ["query_id", "hit_id"], "left")
        .select("query_id", F.lit("turn").alias("hit_type"), "hit_id", F.lit("ASSISTANT").alias("kind"), "content", F.col("hit_id").alias("source_turn_id"), F.greatest(F.col("asked_score") * 0.96, 0.88 * F.coalesce("exact", F.lit(0.0))).alias("score"))
    )
    turns_hit = best(own.select(*out).unionByName(answers.select(*out)), width, F.desc("score"), F.desc("hit_id")).select(*out)
    found = ah.unionByName(turns_hit)
    if shorten:
        found = stored(found.withColumn("_room", F.element_at(F.create_map(*[F.lit(x) for kv in EXCERPT_CHARS.items() for x in kv]), F.col("hit_type"))), "found")
        found = excerpts(found, ["query_id", "hit_type", "hit_id"], q, "_room").withColumn("content", F.col("excerpt")).select(*out)
    return eh.unionByName(found).filter(F.col("hit_type").isin(*kinds))


def merge_hits(hits: DataFrame, limit: int = 8) -> DataFrame:
    """The best `limit` hits of each query: one per hit, then one per text, by score with entries first on ties.

    Of one hit's rows with equal scores the earliest stays, as in a plain loop over them in order.
    """
    order = [F.desc("score"), F.when(F.col("hit_type") == "entry", 0).otherwise(1), F.desc(F.coalesce("source_turn_id", F.lit(0))), F.desc("hit_id")]
    first = [F.desc("score"), F.asc_nulls_last("source_turn_id"), F.asc("content")]
    one = hits.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "hit_type", "hit_id").orderBy(*first))).filter("_n = 1")
    text = F.lower(normalize_text(F.col("content")))
    one = one.withColumn("_n", F.row_number().over(W.partitionBy("query_id", text).orderBy(*order))).filter("_n = 1").drop("_n")
    return one.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= limit)


def search(queries: DataFrame, turns: DataFrame, entries: DataFrame, attachments: DataFrame, limit: int = 8, evidence: bool = True, files: bool = True) -> DataFrame:
    hits = score_hits(queries, turns, entries, attachments, limit=limit)
    if not evidence:
        hits = hits.filter("hit_type <> 'turn'")
    return merge_hits(hits if files else hits.filter("hit_type <> 'attachment'"), limit)


def next_assistant(turns: DataFrame) -> DataFrame:
    """(turn_id, reply_id) of each turn's next assistant turn of its session."""
    after = W.partitionBy("session_id").orderBy("seq").rowsBetween(1, W.unboundedFollowing)
    return turns.select("turn_id", F.first(F.when(F.col("role") == "assistant", F.col("turn_id")), ignorenulls=True).over(after).alias("reply_id")).filter("reply_id is not null")


def _whole_sets(rows: DataFrame) -> DataFrame:
    """(k, hashes, n, _s, _u), stored: the set of all terms of each k of (k, t), its size and two hashes of it.

    Texts are not exchanged if they are read by as many tasks as there are cores; repeated ids are merged then.
    """
    signed = lambda d: d.select("k", "hashes", F.size("hashes").alias("n"), F.xxhash64("hashes").alias("_s"), F.xxhash64(F.lit(1), "hashes").alias("_u"))
    if rows.rdd.getNumPartitions() < rows.sparkSession.sparkContext.defaultParallelism:
        return stored(signed(term_sets(rows, ["k"], "t")), "sets")
    own = stored(signed(term_sets(rows, ["k"], "t", dealt=False)), "sets")
    again = own.groupBy("k").count().filter("count > 1").select("k")
    if again.isEmpty():
        return own
    merged = own.join(again, "k", "left_semi").groupBy("k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hashes")))).alias("hashes"))
    return stored(signed(own.select("k", "hashes").join(again, "k", "left_anti").unionByName(merged)), "merged")


def near_pairs(docs: DataFrame, key: str, text: str, least: float = 0.8) -> DataFrame:
    """(a, b, similarity) of documents whose sets of all terms have Jaccard similarity `least` or more.

    Terms stand for their 64-bit hashes. Equal sets are compared once; different ones by near_sets.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k is not null")
    every = _whole_sets(rows)
    classes = every.groupBy("n", "_s", "_u").agg(F.min("k").alias("one"))
    of = stored(every.select("k", "n", "_s", "_u").join(classes, ["n", "_s", "_u"]).select("k", "one"), "members")
    equal = of.select(F.col("k").alias("a"), "one").join(of.select(F.col("k").alias("b"), "one"), "one").filter("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    if least >= 1:
        return equal
    copies = of.filter("k <> one").select("k")
    alike = near_sets(every.select("k", "n", "hashes"), copies, Fraction(str(least)))
    ends = alike.join(of.select(F.col("k").alias("ka"), F.col("one").alias("a")), "a").join(of.select(F.col("k").alias("kb"), F.col("one").alias("b")), "b")
    across = ends.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "similarity")
    return across.unionByName(equal)
