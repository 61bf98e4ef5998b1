"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame operations only).

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share 1.5 times all
words; a target stops at twice its source's words and the excess is shared again by weight, which
is water-filling and has a closed form over the sources sorted by cap per weight.

Selection: blocks of equally many words go to sources by highest quotients target / (2k + 1), and a
source's blocks to its shards likewise, by shard size. A shard holds the documents of a hash range in
seeded order, so no window spans a whole source; its blocks are taken in a seeded order, a second time
once all are taken. The last block of a quota is trimmed or topped up to the shard's share of the
target, since a shard's last block may be short.

Cases: null text and empty text have size 0 and are taken 0 times; null sources form one source, the
last; repeated rows are taken independently, each at most twice its size; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialize

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 19
#: Blocks that one task makes and orders.
BLOCKS_PER_TASK = 100_000
#: Rows of a dimension up to which it is broadcast; beyond that Spark shuffles both sides.
BROADCAST_ROWS = 100_000


def seeded(seed: str, *cols: Column) -> Column:
    """A uniform number below 2**32, from an MD5 so that any engine gives the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])), 1, 8), 16, 10).cast("long")


def source_targets(sized: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(src, source, source_size, weight, cap_words, target): src is the source's place."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = W.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("src", F.row_number().over(place)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("src") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    )
    by_cap = W.orderBy(F.col("cap_words") / F.col("weight"), "src")
    before, rest, everything = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing), W.partitionBy(F.lit(0))
    per = (
        per.withColumn("cap_words", F.col("source_size") * F.lit(cap))
        .withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap_words").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("k", F.row_number().over(by_cap))
        .withColumn("free", F.col("cap_words") / F.col("weight") > F.col("level"))
    )
    level = F.min(F.when(F.col("free"), F.struct("k", "level"))).over(everything)["level"]
    return per.withColumn("target", F.least(F.col("cap_words"), F.coalesce(F.col("weight") * level, F.col("cap_words")))).select(
        "src", "source", "source_size", "weight", "cap_words", "target"
    )


def sainte_lague(parties: DataFrame, within: list[str], key: str, votes: str, seats: str, out: str) -> DataFrame:
    """Adds `out`: the seats of each party, `seats` in all within each group, by highest quotients votes / (2k + 1).

    Rounding at the plain divisor is at most a few seats off; only those few are ranked by quotient.
    """
    group = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    total = F.sum(votes).over(group)
    p = parties.withColumn("_share", F.coalesce(F.try_divide(F.col(votes).cast("double"), total.cast("double")), F.lit(0.0)))
    p = p.withColumn("_base", F.floor(F.col(seats) * F.col("_share") + 0.5).cast("long"))
    p = p.withColumn("_off", F.col(seats) - F.sum("_base").over(group))
    reach = (F.ceil(F.abs("_off") * F.col("_share")) + 1).cast("int")
    steps = p.filter((F.col("_off") != 0) & (F.col(votes) > 0)).select(*within, key, votes, "_base", "_off", F.explode(F.sequence(F.lit(0), reach)).alias("_j"))
    up = F.col("_off") > 0
    quotient = F.col(votes) / F.when(up, 2 * (F.col("_base") + F.col("_j")) + 1).otherwise(F.greatest(F.lit(1), 2 * (F.col("_base") - F.col("_j")) - 1))
    order = W.partitionBy(*(within or [F.lit(0)])).orderBy(F.when(up, -quotient).otherwise(quotient), key, "_j")
    steps = steps.filter(up | (F.col("_base") > F.col("_j"))).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.abs("_off"))
    moved = steps.groupBy(*within, key).agg(F.sum(F.signum("_off")).cast("long").alias("_moved"))
    return p.join(moved, [*within, key], "left").withColumn(out, F.col("_base") + F.coalesce("_moved", F.lit(0))).drop("_share", "_base", "_off", "_moved")


def small(dim: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(dim) if rows <= BROADCAST_ROWS else dim


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    block: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (its source's), taken."""
    sized = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "sized",
    )
    sources = materialize(source_targets(sized), "sources")
    n_sources = sources.count()
    placed = (
        sized.join(small(sources.withColumnRenamed("source", "_s"), n_sources), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
        .withColumn("shard", F.pmod(seeded(seed + "/shard", F.col("doc_id")), F.col("shards")))
        .withColumn("end", F.sum("size").over(W.partitionBy("src", "shard").orderBy(F.md5(F.concat_ws("|", F.lit(seed + "/order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)))
    )
    placed = materialize(placed.select("doc_id", "source", "size", "src", "source_size", "target", "shard", (F.col("end") - F.col("size")).alias("start"), "end"), "placed")
    # Quotas: blocks to sources, then each source's blocks to its shards.
    blocks_all = F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / block).cast("long")
    quotas = sainte_lague(sources.withColumn("seats", blocks_all), [], "src", "target", "seats", "quota").select("src", "quota", "target", "source_size")
    shards = placed.groupBy("src", "shard").agg(F.sum("size").alias("words")).join(small(quotas, n_sources), "src")
    upto = W.partitionBy("src").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    shards = (
        sainte_lague(shards, ["src"], "shard", "words", "quota", "own_quota")
        .withColumn("upto", F.sum("words").over(upto))
        .withColumn("want", (F.round(F.try_divide(F.col("target") * F.col("upto"), F.col("source_size"))) - F.round(F.try_divide(F.col("target") * (F.col("upto") - F.col("words")), F.col("source_size")))).cast("long"))
        .filter("words > 0")
        .withColumn("n_blocks", F.ceil(F.col("words") / block).cast("long"))
    )
    # The seeded order of a shard's blocks, and how many words of each the first and second pass take.
    order = W.partitionBy("src", "shard").orderBy(F.col("draw"), F.col("block"))
    # Dealt before they are exploded, into a number of partitions that grows with the words: no task makes all blocks.
    dealt = max(1, -(-int(sources.agg(F.sum("source_size")).first()[0] or 0) // (block * BLOCKS_PER_TASK)))
    cells = (
        shards.repartition(dealt, "src", "shard").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
        .withColumn("draw", seeded(seed + "/block", F.col("src"), F.col("shard"), F.col("block")))
        .withColumn("len", F.least(F.lit(block).cast("long"), F.col("words") - F.col("block") * block))
        .withColumn("pos", F.row_number().over(order) - 1)
        .withColumn("before", F.sum("len").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("len"))
    )

    def taken_of(pos: Column, before: Column) -> Column:
        return F.when(pos < F.col("own_quota") + 2, F.greatest(F.lit(0), F.least(F.col("len"), F.col("want") - before))).otherwise(0)

    cells = cells.select("src", "shard", "block", taken_of(F.col("pos"), F.col("before")).alias("first"), taken_of(F.col("pos") + F.col("n_blocks"), F.col("before") + F.col("words")).alias("second"))
    # Each document's words within each block's taken part.
    parts = placed.filter("size > 0").select(
        "doc_id", "src", "shard", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("block")
    )
    head = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    tail = F.col("end") - F.col("block") * block
    within = [F.greatest(F.lit(0), F.least(tail, F.col(c)) - head) for c in ("first", "second")]
    taken = parts.join(cells.hint("merge"), ["src", "shard", "block"]).groupBy("src", "shard", "start", "end").agg(F.sum(within[0] + within[1]).alias("taken"))
    return placed.join(taken, ["src", "shard", "start", "end"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce(F.when(F.col("size") > 0, F.col("taken")), F.lit(0)).cast("long").alias("taken")
    )


def apply_mix(docs: DataFrame, seed: str = "mix", **kw: object) -> DataFrame:
    """The documents as the mix takes them, with the columns of `docs`: each row as often as whole copies are
    taken, and once more with the probability of the rest (a draw seeded by id and text), so a source's words keep
    near its target without cutting a document. Rows are told apart by id, source and size; those alike in all three
    (null counts as a value) take the mean of their words each. An empty table gives an empty result."""
    alike = mix(docs, seed=seed, **kw).groupBy("doc_id", "source", "size").agg(F.avg("taken").alias("words"))
    m = alike.select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), "words")
    n = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    draw = seeded(seed + "/rest", F.col("doc_id"), F.xxhash64("text")) / F.lit(2.0**32)
    # Whole rows travel as one column, so no column of `docs` can clash with the ones made here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("src"), n.alias("n"), draw.alias("draw"))
    joined = rows.join(m, F.col("id").eqNullSafe(F.col("m_id")) & F.col("src").eqNullSafe(F.col("m_source")) & (F.col("n") == F.col("m_size")))
    whole = F.floor(F.try_divide(F.col("words"), F.col("n")))
    copies = F.coalesce(whole + F.when(F.col("draw") < F.try_divide(F.col("words"), F.col("n")) - whole, 1).otherwise(0), F.lit(0)).cast("int")
    return joined.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")
