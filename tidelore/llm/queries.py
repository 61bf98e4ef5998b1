"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, flat_tokens, hilbert, jaccard, mixing, packing, pii, repeats, segments, toxicity
from .common import materialize, table


def op1_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_documents(docs, labels).withColumn("held_out", toxicity.held_out("doc_id")).select("doc_id", "held_out", "score", "predicted", "evidence")


def op2_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op3_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.top_products(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect_pii(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op8_chat_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe -7, formatted and read back."""
    probe = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = materialize(chat.linear_messages(turns), "messages")
    out = chat.format_conversations(messages)
    read = chat.read_back(F.col("formatted"))
    digest = F.sha2(F.array_join(F.transform(read, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    lost = chat.masked_text(F.col("formatted"), F.col("loss_mask"))
    return out.select(
        F.when(F.col("conv") != "null", F.col("conv")).cast("long").alias("conv_id"),
        F.size(read).cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (lower(role) = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (lower(role) = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(replace(replace(replace(replace(role, '\', '\0'), '<', '\1'), '#', '\2'), ':', '\3'))
    + length(replace(replace(replace(text, '\', '\0'), '<', '\1'), '#', '\2'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as flat token blocks without an index and counts each one's tokens by its separators."""
    return flat_tokens.count_documents(flat_tokens.write_flat(table(spark, sf_dir, "documents")))


def op10_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3])) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
x AS (SELECT doc_id, md5(unnest(g)) AS h FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL
"""

OP10_SQL = r"""
WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS src FROM s),
c AS (SELECT *, [5, 2, 1][(src - 1) % 3 + 1] AS weight, source_size * CAST(2 AS DOUBLE) AS cap FROM p),
v AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT *, least(cap, coalesce(weight * (SELECT arg_min(level, cap / weight) FROM v WHERE cap / weight > level), cap)) AS target FROM v),
seats AS (SELECT *, CAST(round(sum(target) OVER () / 64) AS BIGINT) AS seats FROM t),
b AS (SELECT *, CAST(floor(seats * coalesce(target / nullif(sum(target) OVER (), 0), 0) + 0.5) AS BIGINT) AS base FROM seats),
f AS (SELECT *, CAST(seats - sum(base) OVER () AS BIGINT) AS off FROM b),
j AS (SELECT src, target, base, off, unnest(range(0, CAST(ceil(abs(off)) AS BIGINT) + 2)) AS j FROM f WHERE off <> 0 AND target > 0),
jr AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN off > 0 THEN -target / (2 * (base + j) + 1) ELSE target / greatest(1, 2 * (base - j) - 1) END, src, j) AS r FROM j WHERE off > 0 OR base > j),
q AS (SELECT f.src, f.source, f.source_size, f.target, f.base + coalesce((SELECT CAST(sum(sign(off)) AS BIGINT) FROM jr WHERE jr.src = f.src AND r <= abs(jr.off)), 0) AS quota FROM f),
d AS (SELECT z.doc_id, z.source, z.size, q.* EXCLUDE (source), CAST('0x' || substr(md5('mix/shard|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % greatest(1, CAST(ceil(source_size / 524288) AS BIGINT)) AS shard
  FROM z JOIN q ON z.source IS NOT DISTINCT FROM q.source),
e AS (SELECT *, CAST(sum(size) OVER (PARTITION BY src, shard ORDER BY md5('mix/order|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fin FROM d),
h AS (SELECT src, shard, CAST(sum(size) AS BIGINT) AS words, any_value(quota) AS quota, any_value(target) AS target, any_value(source_size) AS source_size FROM e GROUP BY src, shard),
hb AS (SELECT *, CAST(floor(quota * coalesce(words / nullif(CAST(sum(words) OVER (PARTITION BY src) AS DOUBLE), 0), 0) + 0.5) AS BIGINT) AS base, CAST(sum(words) OVER (PARTITION BY src ORDER BY shard) AS BIGINT) AS upto FROM h),
hf AS (SELECT *, CAST(quota - sum(base) OVER (PARTITION BY src) AS BIGINT) AS off FROM hb),
hj AS (SELECT src, shard, words, base, off, unnest(range(0, CAST(abs(off) AS BIGINT) + 2)) AS j FROM hf WHERE off <> 0 AND words > 0),
hr AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN off > 0 THEN -words / (2 * (base + j) + 1) ELSE words / greatest(1, 2 * (base - j) - 1) END, shard, j) AS r FROM hj WHERE off > 0 OR base > j),
hq AS (SELECT hf.*, hf.base + coalesce((SELECT CAST(sum(sign(off)) AS BIGINT) FROM hr WHERE hr.src = hf.src AND hr.shard = hf.shard AND r <= abs(hr.off)), 0) AS own,
  CAST(round(target * upto / source_size) - round(target * (upto - words) / source_size) AS BIGINT) AS want, CAST(ceil(words / 64) AS BIGINT) AS nb FROM hf WHERE words > 0),
k AS (SELECT *, unnest(range(0, nb)) AS block FROM hq),
kd AS (SELECT *, CAST('0x' || substr(md5('mix/block|' || src || '|' || shard || '|' || block), 1, 8) AS BIGINT) AS draw, least(64, words - block * 64) AS len FROM k),
kp AS (SELECT *, row_number() OVER o - 1 AS pos, CAST(sum(len) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - len AS bef FROM kd WINDOW o AS (PARTITION BY src, shard ORDER BY draw, block)),
kt AS (SELECT src, shard, block, CASE WHEN pos < own + 2 THEN greatest(0, least(len, want - bef)) ELSE 0 END AS t1, CASE WHEN pos + nb < own + 2 THEN greatest(0, least(len, want - bef - words)) ELSE 0 END AS t2 FROM kp),
g AS (SELECT e.doc_id, e.size, e.src, e.shard, e.fin, sum(greatest(0, least(e.fin - kt.block * 64, t1) - greatest(e.fin - e.size - kt.block * 64, 0)) + greatest(0, least(e.fin - kt.block * 64, t2) - greatest(e.fin - e.size - kt.block * 64, 0))) AS taken
  FROM e JOIN kt ON e.src = kt.src AND e.shard = kt.shard AND kt.block BETWEEN (e.fin - e.size) // 64 AND (e.fin - 1) // 64 WHERE e.size > 0 GROUP BY ALL)
SELECT e.doc_id, e.source, e.size, e.source_size, CAST(e.target AS DOUBLE) AS target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken
FROM e LEFT JOIN g ON e.src = g.src AND e.shard = g.shard AND e.fin = g.fin AND e.doc_id = g.doc_id AND e.size = g.size
"""

_ALL = (
    op1_toxicity_neighbours,
    op2_hilbert_neighbours,
    op3_segment_top_k,
    op4_pii_anchors,
    op5_suffix_array_dedup,
    op6_best_fit_packing,
    op7_ngram_jaccard,
    op8_chat_paths,
    op9_token_counts,
    op10_sainte_lague_mix,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op3_segment_top_k": OP3_SQL, "op7_ngram_jaccard": OP7_SQL, "op8_chat_paths": OP8_SQL, "op10_sainte_lague_mix": OP10_SQL}
