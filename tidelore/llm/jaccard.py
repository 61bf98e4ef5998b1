"""N-gram Jaccard join: a blocked sparse matrix product of documents by n-grams.

The incidence matrix has a row per document and a column per shingle; its product with its own transpose
holds the overlaps. Blocks of columns are multiplied apart and overlap counts are added up, and pairs that
size-derived bounds exclude go before any whole row is looked at.

1. Rows that cannot have a partner leave first. A fixed fraction of the columns (all of them for short rows) is
   exchanged in packed blocks (exchange.py). A row x with a partner lacks at most |x| - ceil(t |x|) columns in it,
   so if more of its exchanged columns occur nowhere else, it has none. This is exact.
2. Rows with equal sets fall into one class; the smallest id stands for it.
3. All columns of the classes are exchanged the same way, which tells how many of a row's columns no other row has.
   Those left over bound every overlap of the row, and with the sizes they bound its similarity to any other.
4. The m columns of a row that others have are ordered by hash; linked rows share one of their first
   m - ceil(t |x|) + 1. Each of these columns links its rows to one hub in a star; every row checks its most
   frequent hubs in full, and what links is contracted. A group of near copies thus costs a few checks per row.
5. Near copies around a hub are compared by the columns in which they differ from it (_deltas), so that those just below
   the threshold rarely meet. For other pairs across components, the columns of step 4 join kinds of rows, then rows.
   Shared columns of the index are added up within the join; what stays below the bound that the sizes give goes, the
   rest is checked in full.
   Every link between different texts is thus either checked or within a component already.

Cases: null, empty and blank texts have no set and stand alone; a null id stands alone and its component is
null; repeated rows and ids belong to the class of their text (an id with several texts joins their classes only
by links between the texts); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import exchange
from .common import bucketed, buckets_for, materialize, text_buffer, text_bytes
from .components import components
from .shingles import shingle_sets

#: Share of the columns that step 1 exchanges, and the size up to which a row is judged by all its columns.
EXCHANGED = 0.3
SHORT = 64
#: Hubs that a row checks before pairs are counted; it affects the work, not the result.
HUBS = 3

ROWS = "row_id long, doc_id long, n_shingles long, signature binary, hashes array<long>"


class Block:
    """The rows of a text bucket."""

    def __init__(self, t: pa.Table, words: int, num: int, den: int) -> None:
        data, off = text_buffer(t["text"])
        self.h, self.at = shingle_sets(data, off, words)
        self.size = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        low = (self.h & np.uint64(0xFFFF)).astype(np.float64) < EXCHANGED * 65536
        n = self.size[self.doc]
        self.sent = low | (n * num <= SHORT * den)
        self.judged = self.sent if not len(n) else np.where(n <= SHORT, True, low)
        self.key = self.h >> np.uint64(16)

    def candidates(self, answers: pa.Table, num: int, den: int) -> np.ndarray:
        keys, _ = exchange.answered(answers)
        sent, doc = self.key[self.sent], self.doc[self.sent]
        order = np.lexsort((doc, sent))
        k, d = sent[order], doc[order]
        local = np.unique(k[np.flatnonzero((k[1:] == k[:-1]) & (d[1:] != d[:-1])) + 1])
        shared = exchange.member(keys, self.key)[0] | exchange.member(local, self.key)[0]
        rows = len(self.size)
        judged = np.bincount(self.doc[self.judged], minlength=rows)
        alone = np.bincount(self.doc[self.judged & ~shared], minlength=rows)
        lacks = self.size - -(-self.size * num // den)
        return (self.size > 0) & (alone <= lacks) & (judged > 0) | (self.size > 0) & (judged <= lacks)


def needed(n: Column, num: int, den: int) -> Column:
    """ceil(t n)"""
    return F.ceil(n * num / den)


def links(a: Column, b: Column, both: Column, num: int, den: int) -> Column:
    return both * den >= (a + b - both) * num


def _checked(edges: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The edges (a, b) whose whole rows link."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return edges.select("a", "b").join(left, "a").join(right, "b").filter(links(F.col("na"), F.col("nb"), both, num, den)).select("a", "b")


def shared_columns(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Adds `most` to a stored table (node, n, hashes): how many of the row's columns any other row has. Rows that
    lack too many to link with anything are left out."""
    n_buckets = buckets_for(8 * (sets.agg(F.sum("n")).first()[0] or 0))
    ranges = buckets_for(8 * (sets.agg(F.sum("n")).first()[0] or 0), exchange.RANGE_BYTES)
    dealt = sets.withColumn("bkt", F.pmod(F.xxhash64("node"), F.lit(n_buckets)).cast("int"))

    def columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        hashes = t["hashes"].combine_chunks()
        at = np.concatenate([[0], np.cumsum(t["n"].to_numpy())])
        return hashes.flatten().to_numpy().view(np.uint64) >> np.uint64(16), at

    def send(t: pa.Table) -> pa.Table:
        return exchange.cells(columns(t)[0], t["bkt"][0].as_py(), ranges)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, at = columns(left)
        doc = np.repeat(np.arange(left.num_rows), np.diff(at))
        _, inverse, df = np.unique(keys, return_inverse=True, return_counts=True)  # a row has no column twice
        met = (df[inverse] > 1) | exchange.member(exchange.answered(right)[0], keys)[0]
        most = np.bincount(doc[met], minlength=left.num_rows)
        flat = left["hashes"].combine_chunks().flatten().filter(pa.array(met))
        own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(most)]), pa.int32()), flat)
        out = left.select(["node", "n", "hashes"]).append_column("most", pa.array(most, pa.int64())).append_column("met", own)
        return out.filter(pa.array(most * den >= left["n"].to_numpy() * num))

    shared = exchange.shared_keys(dealt.groupBy("bkt").applyInArrow(send, "rng int, bkt int, cell binary"))
    return dealt.groupBy("bkt").cogroup(shared.groupBy("bkt")).applyInArrow(judge, "node long, n long, hashes array<long>, most long, met array<long>")


def _deltas(main: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (node, ref) measured against the shared columns of their hub, the body.

    Adds n, most, body (its size), inside (columns in it), least_need, and prefix: the first columns by which the row
    differs from the body. Two rows of a hub link only if they differ from it in at least
    ceil(t / (1 + t) (n + n')) - inside - inside' + body equal columns, which least_need bounds from below. The prefix
    is null where the row is so far from the hub that its plain columns are the shorter index.
    """
    own = sets.select("node", "n", "most", "met")
    hubs = sets.select(F.col("node").alias("ref"), F.col("met").alias("hub"))
    both = main.join(own, "node").join(hubs, "ref")
    delta = F.sort_array(F.concat(F.array_except("met", "hub"), F.array_except("hub", "met")))
    rows = both.select("node", "ref", "n", "most", F.size("hub").cast("long").alias("body"), delta.alias("delta"))
    rows = rows.withColumn("inside", ((F.col("most") + F.col("body") - F.size("delta")) / 2).cast("long"))
    rows = rows.withColumn("least_need", F.greatest(F.lit(1), F.ceil((F.col("n") + F.col("body")) * num / (num + den)) - F.col("inside")))
    length = F.greatest(F.lit(0), F.size("delta") - F.col("least_need") + 1).cast("int")
    plain = F.col("most") - needed(F.col("n"), num, den) + 1
    return rows.withColumn("prefix", F.when(length <= 2 * plain, F.slice("delta", F.lit(1), length))).drop("delta")


def _certain(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that need no check: rows x, y of a hub overlap in inside + inside' - body columns at least. All
    rows that have such a partner have it in the row of the hub with the largest v."""
    v = F.col("inside") * (num + den) - F.col("n") * num
    top = rows.groupBy("ref").agg(F.max(F.struct(v.alias("v"), "node")).alias("top"))
    found = rows.withColumn("v", v).join(top, "ref").filter((F.col("node") != F.col("top.node")) & (F.col("v") + F.col("top.v") >= F.col("body") * (num + den)))
    return found.select(F.col("node").alias("a"), F.col("top.node").alias("b"))


def _near_hubs(rows: DataFrame, near: DataFrame, least: Callable) -> DataFrame:
    """Pairs (a, b, ca, cb) of rows of one hub in different components that may link, by the columns in which they differ from it."""
    placed = rows.filter("prefix is not null").join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
    index = materialize(placed.withColumn("g", F.explode("prefix")).drop("prefix"), "differences")
    mixed = index.groupBy("ref", "g").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("ref", "g")
    index = index.join(mixed, ["ref", "g"], "left_semi")
    a = index.select("ref", "g", "body", *[F.col(c).alias(f"{x}a") for c, x in SHORT_NAMES.items()])
    b = index.select("ref", "g", *[F.col(c).alias(f"{x}b") for c, x in SHORT_NAMES.items()])
    need = least("na", "nb") - F.col("ia") - F.col("ib") + F.col("body")
    lacks = F.col("body") - F.greatest("ia", "ib")
    more = F.least(F.col("ma") - F.col("ia"), F.col("mb") - F.col("ib"))
    met = a.join(b, ["ref", "g"]).filter((F.col("ca") < F.col("cb")) & (lacks + more >= need))
    met = met.groupBy("xa", "xb", "ca", "cb", need.alias("need"), F.greatest("oa", "ob").alias("o")).agg(F.count("*").alias("k"))
    return met.filter(F.col("k") + F.col("o") - 1 >= F.col("need")).select(F.col("xa").alias("a"), F.col("xb").alias("b"), "ca", "cb")


SHORT_NAMES = {"node": "x", "n": "n", "most": "m", "inside": "i", "least_need": "o", "component": "c"}


def _candidates(rest: DataFrame, fits: Callable, least: Callable, num: int, den: int) -> DataFrame:
    """Pairs (a, b, ca, cb) of rows of different components whose overlap in `rest` (h, at, node, component, kind, index)
    does not exclude a link: `at` is the place of h among the row's shared columns, `index` all columns of the row in `rest`.

    Kinds (ref, n, most) are compared before rows are; ref is -1 for rows far from their hub. Kinds of one hub are left
    to _near_hubs. Then components of the kinds left meet, and only then their rows.
    """
    kinds = rest.groupBy("h", "kind").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    p, q = (kinds.select("h", F.col("kind").alias(x), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}")) for x in "pq")
    possible = fits("p.n", "q.n", "p.most", "q.most") & ((F.col("p.ref") != F.col("q.ref")) | (F.col("p.ref") < 0))
    several = F.least("lo_p", "lo_q") < F.greatest("hi_p", "hi_q")
    met = p.join(q, "h").filter((F.col("p") <= F.col("q")) & several & possible).select("h", "p", "q")
    cells = rest.select("h", "kind", "component").distinct()
    met = met.join(cells.select("h", F.col("kind").alias("p"), F.col("component").alias("ca")), ["h", "p"])
    met = met.join(cells.select("h", F.col("kind").alias("q"), F.col("component").alias("cb")), ["h", "q"])
    met = met.filter((F.col("ca") != F.col("cb")) & ((F.col("p") < F.col("q")) | (F.col("ca") < F.col("cb"))))
    # A pair comes out once, at its first shared column, which stands early in both rows if they can link, and only if the bounds allow it.
    a = rest.select("h", F.col("kind").alias("p"), F.col("component").alias("ca"), F.col("node").alias("a"), F.col("at").alias("at_a"), F.col("index").alias("ia"))
    b = rest.select(F.col("h").alias("hb"), F.col("kind").alias("kb"), F.col("component").alias("of"), F.col("node").alias("b"), F.col("at").alias("at_b"), F.col("index").alias("ib"))
    met = met.join(a, ["h", "p", "ca"]).filter(F.col("at_a") <= F.col("p.most") - least("p.n", "q.n"))
    both = F.array_intersect("ia", "ib")
    may = F.size(both) + F.greatest(needed(F.col("p.n"), num, den), needed(F.col("q.n"), num, den)) - 1 >= least("p.n", "q.n")
    early = F.col("at_b") <= F.col("q.most") - least("p.n", "q.n")
    same = (F.col("h") == F.col("hb")) & (F.col("q") == F.col("kb")) & (F.col("cb") == F.col("of"))
    return met.join(b, same & early & (F.array_min(both) == F.col("h")) & may).select("a", "b", "ca", "cb")


def link_sets(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component) of every node of the stored table `sets` (node, n, hashes ascending) that links with another."""
    sets = materialize(shared_columns(sets, num, den), "shared")
    size = F.col("n").cast("long")
    first = materialize(sets.select("node", "n", "most", F.posexplode(F.slice("met", F.lit(1), (F.col("most") - needed(size, num, den) + 1).cast("int"))).alias("at", "h")), "columns")
    least = lambda x, y: F.ceil((F.col(x) + F.col(y)) * num / (num + den))
    fits = lambda x, y, mx, my: F.least(mx, my) >= least(x, y)
    # The hub is the row that lacks least: near the middle of its group.
    star = first.groupBy("h").agg(F.min(F.struct((F.col("n") - F.col("most")).alias("lack"), "node", "n", "most")).alias("hub"), F.count("*").alias("k")).filter("k > 1")
    star = star.select("h", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.most").alias("hub_most"))
    spokes = first.join(star, "h").groupBy("node", "hub").agg(F.count("*").alias("overlap"), F.max(fits("n", "hub_n", "most", "hub_most")).alias("fits"))
    spokes = materialize(spokes, "spokes")
    rank = F.row_number().over(W.partitionBy("node").orderBy(F.desc("overlap"), "hub"))
    best = spokes.filter("fits and node != hub").withColumn("r", rank).filter(F.col("r") <= HUBS).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    main = materialize(spokes.withColumn("r", rank).filter("r = 1").select("node", F.col("hub").alias("ref")), "refs")
    rows = materialize(_deltas(main, sets, num, den), "deltas")
    near = materialize(components(_checked(best, sets, num, den).unionByName(_certain(rows, num, den))), "contracted")
    # Columns that still join different components.
    placed = first.join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("h")
    rest = materialize(placed.join(mixed, "h", "left_semi"), "mixed")
    far = F.when(F.col("prefix").isNull(), -1).otherwise(F.col("ref")).cast("long")
    kind = F.struct(far.alias("ref"), "n", "most").alias("kind")
    index = rest.groupBy("node").agg(F.collect_list("h").alias("index"))
    rest = materialize(rest.select("h", "at", "node", "component").join(rows.select("node", kind), "node").join(index, "node"), "kinds")
    across = _candidates(rest, fits, least, num, den)
    across = materialize(across.unionByName(_near_hubs(rows, near, least)), "pairs")
    joined = _checked(across, sets, num, den).join(across.select("a", "b", "ca", "cb"), ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    top = components(joined).select(F.col("node").alias("component"), F.col("component").alias("top"))
    near = near.unionByName(top.select(F.col("component").alias("node"), "component").join(near, "node", "left_anti"))
    return near.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def jaccard_components(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id. Documents link when |x & y| / |x | y| >= num / den."""
    total = text_bytes(docs, text_col)
    ranges = buckets_for(total, exchange.RANGE_BYTES)
    dealt = bucketed(docs, id_col, text_col, buckets_for(total, bucket_bytes))

    def send(t: pa.Table) -> pa.Table:
        b = Block(t, words, num, den)
        return exchange.cells(b.key[b.sent], t["bkt"][0].as_py(), ranges)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left["doc_id"]
        b = Block(left, words, num, den)
        keep = b.candidates(right, num, den) & ids.is_valid().to_numpy()
        signed = b.h.view(np.int64)
        sets, marks = [], []
        for k in range(len(keep)):
            own = signed[b.at[k] : b.at[k + 1]] if keep[k] else None
            sets.append(own)
            marks.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if keep[k] else None)
        n = left.num_rows
        first = (left["bkt"][0].as_py() << 32) if n else 0
        return pa.table([pa.array(np.arange(first, first + n), pa.int64()), ids.combine_chunks() if n else pa.array([], pa.int64()), pa.array(b.size, pa.int64()), pa.array(marks, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["row_id", "doc_id", "n_shingles", "signature", "hashes"])

    shared = exchange.shared_keys(dealt.groupBy("bkt").applyInArrow(send, "rng int, bkt int, cell binary"))
    rows = materialize(dealt.groupBy("bkt").cogroup(shared.groupBy("bkt")).applyInArrow(judge, ROWS), "rows")
    alone = rows.filter("signature is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = rows.filter("signature is not null")
    classes = materialize(found.groupBy("signature").agg(F.min(F.struct("doc_id", "row_id")).alias("m")).select("signature", F.col("m.doc_id").alias("node"), F.col("m.row_id").alias("row_id")), "classes")
    sets = materialize(found.join(classes.select("row_id"), "row_id", "left_semi").select("row_id", F.col("n_shingles").alias("n"), "hashes").withColumnRenamed("row_id", "node"), "sets")
    # Nodes are rows, as an id may repeat; a component is named by the least id of its classes.
    linked = materialize(link_sets(sets, num, den), "linked")
    named = classes.join(linked.withColumnRenamed("node", "row_id"), "row_id", "left").withColumn("component", F.coalesce("component", "row_id"))
    least = named.groupBy("component").agg(F.min("node").alias("component_id"))
    named = named.join(least, "component").select("signature", "component_id")
    return alone.unionByName(found.select("doc_id", "n_shingles", "signature").join(named, "signature").drop("signature"))
