"""Chat formatting over reply trees (DataFrame operations only).

Messages form trees by parent. Pointer jumping (iterative self-joins that double the step) finds every
message's depth and its ancestors at powers of two; each leaf's path is then enumerated by halving: a
stretch of the path splits into two at the stored ancestor, until each stretch is one message. Paths are
ranked by score within a conversation and each chosen one is formatted as one conversation.

Template: a turn is `### role: text </turn>` and a newline; within roles and texts a backslash becomes
`\\0`, `<` becomes `\\1`, `#` becomes `\\2` and, in roles, `:` becomes `\\3`, so no control string can occur
there, and undoing 1 to 3 before 0 is exact.

Cases: null role or text counts as empty; repeated (conversation, turn) rows are turns of their own, ordered
by role and text; null conversation ids form one conversation; an unknown parent starts a tree; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialize

HEAD, COLON, END = "### ", ": ", " </turn>\n"
ASSISTANT = "assistant"


def _swap(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_CODES = [("\\", "\\0"), ("<", "\\1"), ("#", "\\2"), (":", "\\3")]


def escape(c: Column, role: bool = False) -> Column:
    return _swap(c, _CODES if role else _CODES[:3])


def unescape(c: Column) -> Column:
    return _swap(c, [(b, a) for a, b in reversed(_CODES)])


def reply_paths(messages: DataFrame) -> DataFrame:
    """(leaf, node, depth) for every message on the path from its root to every leaf.

    `messages` has node, parent (null for a root) and is a forest; ids are unique. Replies in a cycle raise ValueError.
    """
    m = messages.select("node", "parent")
    known = m.select(F.col("node").alias("_p"))
    jump = m.join(known, F.col("parent") == F.col("_p"), "left").select("node", F.col("_p").alias("up"))
    leaves = m.join(m.select(F.col("parent").alias("node")).filter("node is not null").distinct(), "node", "left_anti")
    jump = materialize(jump.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1)), "jump")
    levels = [jump]  # levels[k].up: the ancestor 2**k above
    most = jump.count().bit_length()  # no path of a forest is longer than all its messages
    while (first := levels[-1].filter("up is not null").first()) is not None:
        if len(levels) > most:
            raise ValueError(f"message {first['node']} is in a cycle of replies or below one")
        a = levels[-1]
        b = a.select(F.col("node").alias("up"), F.col("up").alias("_up2"), F.col("depth").alias("_d"))
        # Only messages that still have an ancestor join; the others keep their depth.
        on = a.filter("up is not null").join(b, "up").select("node", F.col("_up2").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"))
        levels.append(materialize(on.unionByName(a.filter("up is null")), "jump"))
    depth = levels[-1].select("node", "depth")
    # A stretch (leaf, node, n) stands for node and its n - 1 next ancestors; n is at most 2**k before round k.
    stretch = materialize(leaves.join(depth, "node").select(F.col("node").alias("leaf"), "node", (F.col("depth") + 1).alias("n"), "depth"), "stretches")
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        cut = F.col("n") > step
        upper = stretch.filter(cut).join(levels[k].select("node", "up"), "node").select("leaf", F.col("up").alias("node"), (F.col("n") - step).alias("n"), (F.col("depth") - step).alias("depth"))
        # Stored, since the next round reads it twice: plans would double with every round.
        stretch = materialize(stretch.withColumn("n", F.least(F.col("n"), F.lit(step))).unionByName(upper), "stretches")
    return stretch.select("leaf", "node", "depth")


def format_turns(paths: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: n_turns, formatted, loss_mask (start, length of each assistant text, code points from 0).

    `paths` has the columns of `by` and depth, role, text.
    """
    turn = F.struct("depth", F.lower("role").eqNullSafe(ASSISTANT).alias("loss"), escape(F.coalesce("role", F.lit("")), True).alias("r"), escape(F.coalesce("text", F.lit(""))).alias("t"))
    d = paths.groupBy(*by).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    piece = lambda t: F.concat(F.lit(HEAD), t["r"], F.lit(COLON), t["t"], F.lit(END))
    d = d.withColumn("formatted", F.array_join(F.transform("turns", piece), ""))
    # Running offsets: the state is (offset, mask so far).
    fixed = len(HEAD) + len(COLON)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))

    def step(s: Column, t: Column) -> Column:
        here = s["at"] + fixed + F.length(t["r"])
        own = F.when(t["loss"], F.array(F.struct(here.alias("start"), F.length(t["t"]).alias("length")))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
        return F.struct((here + F.length(t["t"]) + len(END)).alias("at"), F.concat(s["mask"], own).alias("mask"))

    return d.select(*by, F.size("turns").cast("long").alias("n_turns"), "formatted", F.aggregate("turns", start, step)["mask"].alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    parts = F.filter(F.split(formatted, " </turn>\n"), lambda p: p != "")
    colon = lambda p: F.instr(p, ": ")
    return F.transform(parts, lambda p: F.struct(unescape(F.substring(p, F.lit(len(HEAD) + 1), colon(p) - 1 - len(HEAD))).alias("role"), unescape(F.substring(p, colon(p) + 2, F.length(p))).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"]))), "")


def format_conversations(messages: DataFrame, paths_per_conversation: int = 1) -> DataFrame:
    """Formats the best paths of each conversation: conv, leaf, path_rank, path_score, n_turns, formatted, loss_mask.

    `messages` has conv (string key), node (unique), parent, role, text, score. A path's score is the mean of
    its messages' scores (null: 0); ties go to the smaller leaf.
    """
    on_path = reply_paths(messages)
    full = on_path.join(messages.select("node", "conv", F.coalesce("score", F.lit(0.0)).alias("score")), "node")
    scored = full.groupBy("leaf").agg(F.first("conv").alias("conv"), F.avg("score").alias("path_score"))
    best = scored.withColumn("path_rank", F.row_number().over(W.partitionBy("conv").orderBy(F.desc("path_score"), "leaf"))).filter(F.col("path_rank") <= paths_per_conversation)
    chosen = on_path.join(best, "leaf").join(messages.select("node", "role", "text"), "node")
    return format_turns(chosen, ["conv", "leaf", "path_rank", "path_score"])


def linear_messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Reply trees of plain turn lists: each turn answers the one before it."""
    key = F.coalesce(F.col(conv).cast("string"), F.lit("null"))
    w = W.partitionBy("conv").orderBy("turn", "role", "text")
    t = turns.select(key.alias("conv"), F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("i", F.row_number().over(w))
    name = lambda i: F.concat_ws(":", "conv", F.format_string("%09d", i))
    return t.select("conv", "conv_id", name(F.col("i")).alias("node"), F.when(F.col("i") > 1, name(F.col("i") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
