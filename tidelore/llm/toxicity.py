"""Toxicity from the nearest labelled examples.

Terms are words and their prefixes of 4 to 6 letters, so an inflected form that no example holds still meets
its stem. The vocabulary is all terms of the fitted examples; document frequencies count all documents. A term's
weight is its TF-IDF times sqrt(1 + G), G being its log-likelihood ratio with the label in the examples: terms that
go with the label count for more, none counts for nothing. Each document's vector meets the examples in a block-max
inverted index: per term, postings are cut into blocks of examples with their largest weight, blocks are visited by
falling bound, and a block is left out only if its bound does not reach the k-th best, so the k nearest by cosine are
exact (ties to the smaller id). Documents are searched a few hundred at a time, so that a block's common terms are one
matrix product for all documents that visit it. Votes weigh by 1 / (distance + c); a logistic curve fitted on the
examples, each scored without itself, turns them into probabilities.

The only bound is `per_class`: at most that many examples of each label are fitted, the first by a hash. Votes
undo the uneven sampling of the labels by weights.

Cases: null and empty texts, and texts without any term of an example, get the score of no evidence; labels that are
null or whose document is missing teach nothing; of several labels of a document the largest counts, and of several
texts the first in order; repeated rows are scored each; without examples of both labels every score is the smoothed share of label 1; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import materialize, text_buffer
from .lexicon import Lexicon, distinct_terms

PER_CLASS = 3000
NEIGHBOURS = 15
BLOCK = 64
#: Blocks of each document that a search visits first.
FIRST_BLOCKS = 8
#: Share of the examples from which on a term is common, groups of similar examples, documents that are searched at once.
COMMON = 0.05
GROUPS = 16
TOGETHER = 256
#: Postings of one line; a list fills whole lines, the last one with zeros.
LINE = 8
#: Error of a cosine in single precision, and more.
SLACK = 1e-4
#: Examples that an index takes in at once.
TAKEN = 256
#: Terms whose document counts travel in one row.
COUNTED_TERMS = 1 << 14
FOLDS = 5


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def _likelihood(a: np.ndarray, b: np.ndarray, na: float, nb: float) -> np.ndarray:
    """G squared of a presence count in two samples."""

    def part(x: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(e, 1e-300)), 0.0)

    share = (a + b) / (na + nb)
    return 2 * (part(a, na * share) + part(b, nb * share) + part(na - a, na * (1 - share)) + part(nb - b, nb * (1 - share)))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of every range, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Index:
    """Block-max inverted index over the examples, which are bounded in number.

    Terms in a small share of the examples have posting lists, kept in lines. The postings of the others (`common`) are rows of a
    matrix, cut into blocks of examples, with the largest weight of each term in each block in `peak`. Examples that
    are alike are put into the same blocks, which keeps these bounds low. Weights are single-precision numbers.
    """

    def __init__(self, ids: np.ndarray, y: np.ndarray, vectors: tuple[np.ndarray, np.ndarray, np.ndarray], scale: np.ndarray, totals: tuple[float, float]) -> None:
        self.scale, self.prior, self.curve = scale, (totals[1] + 1) / (sum(totals) + 2), (1.0, 0.0)
        n = len(ids)
        self.n, self.blocks = n, max(1, -(-n // BLOCK))
        row, term, tf = vectors
        ends = np.searchsorted(row, np.arange(n + 1, dtype=row.dtype))
        # A few examples at a time: every worker builds this, and all their numbers at once would take more than the index.
        taken = [(a, min(a + TAKEN, n), slice(ends[a], ends[min(a + TAKEN, n)])) for a in range(0, n, TAKEN)]
        held = np.zeros(len(scale), np.int32)
        for _, _, own in taken:
            held += np.bincount(term[own], minlength=len(scale))
        self.place = np.full(len(scale), -1, np.int32)
        common = np.flatnonzero(held >= COMMON * n)
        self.place[common] = np.arange(len(common))
        self.dense = np.zeros((self.blocks * BLOCK, len(common)), np.float32)
        held[common] = 0
        lines = -(-held // LINE)
        self.start = np.concatenate([[0], np.cumsum(lines)])
        self.rows, self.values = np.zeros((self.start[-1], LINE), np.uint16 if n <= 1 << 16 else np.int32), np.zeros((self.start[-1], LINE), np.float32)
        free = self.start[:-1] * LINE
        for a, b, own in taken:
            doc, terms = row[own].astype(np.int64), term[own]
            value = self.weights(doc - a, terms, tf[own], b - a).astype(np.float32)
            place = self.place[terms]
            rare = place < 0
            self.dense[doc[~rare], place[~rare]] = value[~rare]
            doc, terms, value = doc[rare], terms[rare], value[rare]
            by = np.argsort(terms, kind="stable")
            doc, terms, value = doc[by], terms[by], value[by]
            new = np.flatnonzero(np.diff(terms, prepend=-1))
            size = np.diff(new, append=len(terms))
            at = _ranges(free[terms[new]], size)
            self.rows.ravel()[at], self.values.ravel()[at] = doc, value
            free[terms[new]] += size
        order = np.lexsort((ids, alike(self.dense[:n])))
        back = np.empty(n, self.rows.dtype)
        back[order] = np.arange(n)
        for a in range(0, len(common), TAKEN):
            self.dense[:n, a : a + TAKEN] = self.dense[order, a : a + TAKEN]
        for a in range(0, len(self.rows), 1 << 16):
            self.rows[a : a + (1 << 16)] = back[self.rows[a : a + (1 << 16)]]
        self.peak = self.dense.reshape(self.blocks, BLOCK, len(common)).max(1).T.copy()
        self.ids, self.y, self.order, self.back = ids[order], y[order].astype(float), order, back
        have = np.array([max(1, (y == c).sum()) for c in (0, 1)], float)
        weight = np.where(self.y == 1, totals[1] / have[1], totals[0] / have[0])
        self.weight = weight / weight.mean() if n else weight

    def weights(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        """Unit vectors of n documents."""
        v = np.log(tf, dtype=float)
        v += 1
        v *= self.scale[term]
        v /= np.sqrt(np.bincount(doc, weights=v * v, minlength=n))[doc]
        return v

    def search(self, doc: np.ndarray, term: np.ndarray, v: np.ndarray, n_docs: int, k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of n_docs vectors the k examples of largest cosine above 0, nearest first, ties to the smaller id.

        The posting lists are added up first. With the peaks of the common terms they bound each block; blocks are
        visited by falling bound, FIRST_BLOCKS of each document and then those whose bound reaches its k-th best. Single
        precision is only used to leave examples out, with SLACK to spare; cosines are then computed in double
        precision, and count as equal if they agree in 12 decimals.
        """
        width = self.blocks * BLOCK
        place = self.place[term]
        rare = place < 0
        sums = self._listed(doc[rare], term[rare], v[rare], n_docs, width)
        query = np.zeros((n_docs, self.dense.shape[1]))
        query[doc[~rare], place[~rare]] = v[~rare]
        single = query.astype(np.float32)
        bound = single @ self.peak + sums.reshape(n_docs, self.blocks, BLOCK).max(2)
        found = np.full((n_docs, width), -1.0, np.float32)
        first = min(FIRST_BLOCKS, self.blocks)
        turn = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        wanted = np.zeros((n_docs, self.blocks), bool)
        np.put_along_axis(wanted, turn, True, 1)
        wanted &= bound > 0
        self._visit(wanted, single, sums, found, without)
        best = np.take_along_axis(found.reshape(n_docs, self.blocks, BLOCK), turn[:, :, None], 1).reshape(n_docs, -1)
        kth = np.maximum(-np.partition(-best, min(k, best.shape[1]) - 1, axis=1)[:, min(k, best.shape[1]) - 1], 0)
        self._visit((bound >= kth[:, None] - SLACK) & (bound > 0) & ~wanted, single, sums, found, without)
        out = []
        for d in range(n_docs):
            near = np.flatnonzero(found[d] >= kth[d] - SLACK)
            if len(near) > k:
                least = -np.partition(-found[d][near], k - 1)[k - 1] - SLACK
                near = near[found[d][near] >= least]
            held = np.flatnonzero(query[d])
            sims = np.round(sums[d, near] + self.dense[near[:, None], held].astype(float) @ query[d, held], 12)
            near, sims = near[sims > 0], sims[sims > 0]
            top = np.lexsort((self.ids[near], -sims))[:k]
            out.append((near[top], sims[top]))
        return out

    def _listed(self, doc: np.ndarray, term: np.ndarray, v: np.ndarray, n_docs: int, width: int) -> np.ndarray:
        """Products over the posting lists, one document at a time: its sums stay in the processor's cache."""
        out = np.zeros((n_docs, width))
        at = self.start[term]
        size = self.start[term + 1] - at
        cut = np.searchsorted(doc, np.arange(n_docs + 1)).tolist()
        for d, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            lines = _ranges(at[a:b], size[a:b])
            if len(lines):
                held = self.values.take(lines, axis=0) * np.repeat(v[a:b], size[a:b])[:, None]
                out[d] = np.bincount(self.rows.take(lines, axis=0).ravel(), weights=held.ravel(), minlength=width)
        return out

    def _visit(self, wanted: np.ndarray, single: np.ndarray, sums: np.ndarray, found: np.ndarray, without: np.ndarray | None) -> None:
        """Fills `found` for the (document, block) pairs wanted."""
        for b in np.flatnonzero(wanted.any(0)):
            own = np.flatnonzero(wanted[:, b])
            cols = slice(b * BLOCK, min((b + 1) * BLOCK, self.n))
            found[own, cols] = single[own] @ self.dense[cols].T + sums[own, cols]
        if without is not None:
            found[np.arange(len(found)), without] = -1.0

    def nearest(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """search() of term counts."""
        return self.search(doc, term, self.weights(doc, term, tf, n_docs), n_docs, k, without)

    def vote(self, near: np.ndarray, sims: np.ndarray) -> float:
        w = self.weight[near] / (1.05 - np.minimum(sims, 1.0))
        return float(((w * self.y[near]).sum() + self.prior) / (w.sum() + 1.0))

    def score(self, raw: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-(a * math.log(raw / (1 - raw)) + b)))


def alike(rows: np.ndarray) -> np.ndarray:
    """A group of similar rows for each row (a few rounds of spherical k-means); it affects the work of a search, not its result."""
    n = len(rows)
    if not n or not rows.shape[1]:
        return np.zeros(n, np.int64)
    centre = rows[np.linspace(0, n - 1, min(GROUPS, n)).astype(int)]
    for _ in range(5):
        own = (rows @ centre.T).argmax(1)
        centre = (own == np.arange(len(centre))[:, None]).astype(np.float32) @ rows
        centre /= np.maximum(np.sqrt((centre * centre).sum(1, keepdims=True)), 1e-9)
    return own


@dataclass
class Examples:
    """Term counts of the examples (by ids, ascending), from which every worker builds the index for itself; it goes
    with the broadcast that holds it, and the counts go once it is built."""

    ids: np.ndarray
    y: np.ndarray
    sizes: np.ndarray
    terms: np.ndarray | None
    tf: np.ndarray | None
    scale: np.ndarray
    totals: tuple[float, float]
    built: Index | None = None

    def index(self) -> Index:
        if self.built is None:
            row = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
            self.built = Index(self.ids, self.y, (row, self.terms, self.tf), self.scale, self.totals)
            self.terms = self.tf = None
        return self.built

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Positions of some examples in the index."""
        return self.index().back[np.searchsorted(self.ids, ids)].astype(np.int64)


def _cells(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in binary cells end to end, and how many each has."""
    raw, ends = text_buffer(column)
    return raw.view("<i4"), np.diff(ends) // 4


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept by Newton's method; the slope stays positive."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = w * (p - y), w * p * (1 - p) + 1e-9
        ga, gb = (g * x).sum() + ridge * (a - 1), g.sum() + ridge * b
        haa, hab, hbb = (h * x * x).sum() + ridge, (h * x).sum(), h.sum() + ridge
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = max(0.05, a - step * da), b - step * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return float(a), float(b)


def _examples(labels: DataFrame, per_class: int, id_col: str, label_col: str) -> tuple[list[tuple[int, int]], tuple[float, float]]:
    """At most per_class (doc, label) of each label by hash, and how many there are in all."""
    own = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    own = own.groupBy(F.col(id_col).cast("long").alias("doc")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("y"))
    totals = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen: list[tuple[int, int]] = []
    for c in (0, 1):
        chosen += [(r["doc"], c) for r in own.filter(F.col("y") == c).orderBy(F.xxhash64("doc"), "doc").limit(per_class).collect()]
    return chosen, (float(totals.get(0, 0)), float(totals.get(1, 0)))


def score_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of docs: row (a struct of all its columns), score, evidence (ids of the three nearest examples)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chosen, totals = _examples(labels, per_class, id_col, label_col)
    # At most 2 * per_class rows; as a table, since a list would start further Python processes on the executors.
    picked = pa.table([pa.array([x[i] for x in chosen], kind) for i, kind in enumerate((pa.int64(), pa.int32()))], names=["doc_id", "y"])
    sample = F.broadcast(spark.createDataFrame(picked, "doc_id long, y int"))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _groups(batches):
            doc, term, parent = distinct_terms(own["text"].to_pylist())
            term, first, at = np.unique(term, return_index=True, return_inverse=True)
            y = own["y"].to_numpy()[doc]
            n = [np.bincount(at[y == c], minlength=len(term)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (term.view(np.int64), parent[first].view(np.int64), *n)], names=["term", "parent", "n0", "n1"])

    # Of several texts of a labelled id the first in order teaches.
    taught = materialize(texts.join(sample, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "examples")
    met = {r["y"]: r["n"] for r in taught.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = met.get(0, 0), met.get(1, 0)
    # All terms of at most 2 * per_class texts
    known = taught.select("text", "y").mapInArrow(presence, "term long, parent long, n0 long, n1 long").groupBy("term").agg(F.max("parent").alias("parent"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    met_terms = known.filter(F.lit(bool(n0 and n1))).toArrow()
    hashes, above = (met_terms[c].to_numpy().view(np.uint64) for c in ("term", "parent"))
    n_terms, order = len(hashes), np.argsort(hashes)
    hashes, above = hashes[order], above[order]
    ratio = _likelihood(*(met_terms[c].to_numpy()[order].astype(float) for c in ("n0", "n1")), float(n0), float(n1)) if n_terms else np.zeros(0)
    words = spark.sparkContext.broadcast((hashes, np.where(above == 0, -1, np.searchsorted(hashes, above))))
    del met_terms, hashes, above

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*words.value)
        seen = np.zeros(n_terms, np.int64)
        for own in _groups(batches):
            seen += lexicon.presence(own["text"].to_pylist())
        parts = range(0, n_terms if seen.any() else 0, COUNTED_TERMS)
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(parts), pa.int32()), "seen": pa.array([seen[a : a + COUNTED_TERMS].tobytes() for a in parts], pa.binary())})

    def total(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "seen": pa.array([sum(np.frombuffer(x.as_py(), np.int64) for x in table["seen"]).tobytes()], pa.binary())})

    n = texts.count()
    df = np.zeros(n_terms)
    schema = "part int, seen binary"
    for r in texts.select("text").mapInArrow(frequencies, schema).groupBy("part").applyInArrow(total, schema).toLocalIterator():
        df[r["part"] : r["part"] + COUNTED_TERMS] = np.frombuffer(r["seen"], np.int64)
    scale = (np.log((n + 1) / (df + 1)) + 1) * np.sqrt(1 + np.maximum(ratio, 0))

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*words.value)
        for own in _groups(batches):
            doc, term, tf = lexicon.counts(own["text"].to_pylist())
            ends = np.searchsorted(doc, np.arange(own.num_rows + 1))
            cut = lambda x: pa.array([x[a:b].astype("<i4").tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([own["doc_id"], own["y"], cut(term), cut(tf)], names=["doc_id", "y", "terms", "tf"])

    vectors = materialize(taught.select("doc_id", "y", "text").mapInArrow(teach, "doc_id long, y int, terms binary, tf binary"), "vectors")
    rows = vectors.toArrow().sort_by("doc_id")
    terms, sizes = _cells(rows["terms"])
    tf, _ = _cells(rows["tf"])
    tf = tf.astype(np.min_scalar_type(tf.max(initial=0)))
    taught_by = Examples(rows["doc_id"].to_numpy().astype(np.int64), rows["y"].to_numpy().astype(np.int64), sizes.astype(np.int32), terms, tf, scale, totals)
    n_examples = rows.num_rows
    del rows
    shared = spark.sparkContext.broadcast(taught_by)
    del terms, tf, taught_by

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Votes of examples, each scored without itself."""
        for own in _groups(batches):
            ix, at = shared.value.index(), shared.value.places(own["doc_id"].to_numpy())
            term, size = _cells(own["terms"])
            near = ix.nearest(np.repeat(np.arange(len(at)), size), term, _cells(own["tf"])[0], len(at), NEIGHBOURS, at)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([ix.vote(*x) for x in near], pa.float64()), pa.array(ix.y[at]), pa.array(ix.weight[at])], names=["at", "raw", "y", "weight"])

    curve = (1.0, 0.0)
    if n_examples:
        own = vectors.select("doc_id", "terms", "tf").mapInArrow(votes, "at long, raw double, y double, weight double").toArrow().sort_by("at")
        raw, y, weight = (own[c].to_numpy() for c in ("raw", "y", "weight"))
        curve = logistic(np.log(raw / (1 - raw)), y, weight) if 0 < y.sum() < len(y) else curve

    # A text that is a column of the row travels within it, not twice.
    field = [c for c, kind in docs.dtypes if kind == "string"]
    field = docs.columns.index(text_col) if text_col in field else None

    def own_texts(own: pa.RecordBatch) -> list[str]:
        return [x or "" for x in (own["text"] if field is None else pc.struct_field(own["row"], field)).to_pylist()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value.index()
        ix.curve = curve
        lexicon = Lexicon(*words.value)
        for own in _groups(batches):
            near = ix.nearest(*lexicon.counts(own_texts(own)), own.num_rows, NEIGHBOURS)
            scores = pa.array([ix.score(ix.vote(*x)) for x in near], pa.float64())
            evidence = pa.array([ix.ids[x[:3]].tolist() for x, _ in near], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([own["row"], scores, evidence], names=["row", "score", "evidence"])

    schema = StructType([StructField("row", docs.schema), StructField("score", DoubleType()), StructField("evidence", ArrayType(LongType()))])
    given = docs.select(F.struct("*").alias("row"), *([F.col(text_col).cast("string").alias("text")] if field is None else []))
    return given.mapInArrow(score, schema)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of rows that are worked on at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(a, TOGETHER)


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, score, predicted, evidence (ids of the three nearest examples)."""
    rows = score_rows(docs.select(id_col, text_col), labels, per_class, id_col, text_col, label_col)
    return rows.select(F.col("row")[id_col].cast("long").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
