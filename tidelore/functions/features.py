"""Weighted lexical features: a document's Latin tokens, CJK phrases and grams.

`feature_rows` gives them as an expression, for short texts; `text_terms` counts the same features in Python workers, at
a small part of the time, for whole tables. Weights are summed in tenths, as integers, so sums don't depend on order.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import constants as K
from .text import CJK_LETTER, is_upper, latin_tokens, strong_anchors

TERM = "array<struct<term:string,tenths:bigint>>"


def _pair(term: Column, tenths: Column) -> Column:
    return F.struct(term.alias("term"), tenths.cast("long").alias("tenths"))


def _among(c: Column, words: list[str]) -> Column:
    return c.isin(*words)


def latin_features(normalized: Column) -> Column:
    kept = F.filter(latin_tokens(normalized), lambda t: (F.length(t["clean"]) >= 2) & ~_among(t["clean"], K.ENGLISH_STOP))
    marked = lambda t: t["clean"].rlike("[0-9]") | t["raw"].rlike("[._]") | is_upper(t["raw"])
    return F.transform(kept, lambda t: _pair(t["clean"], F.when(F.length(t["clean"]) >= 4, K.LATIN_LONG).otherwise(K.LATIN_SHORT) + F.when(marked(t), K.LATIN_MARKED).otherwise(0)))


def _grams(run: Column, n: int) -> Column:
    size = F.length(run)
    at = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(run, i, F.lit(n)))


def cjk_features(normalized: Column) -> Column:
    runs = F.filter(F.regexp_extract_all(F.lower(normalized), F.lit(f"({CJK_LETTER}+)")), lambda r: ~_among(r, K.CHINESE_STOP))
    empty = F.array().cast(TERM)
    edge = f"[{K.CHINESE_EDGE}]"

    def weighted_grams(r: Column, n: int, tenths: int) -> Column:
        plain = F.filter(_grams(r, n), lambda g: ~_among(g, K.CHINESE_STOP) & ~g.rlike(f"^{edge}|{edge}$") & (F.length(F.regexp_replace(g, edge, "")) >= max(1, n - 1)))
        return F.transform(plain, lambda g: _pair(g, F.lit(tenths)))

    def of_run(r: Column) -> Column:
        many = F.length(r) > 1
        single = F.when(~many & r.rlike(f"^[{K.CHINESE_KEY}]$"), F.array(_pair(r, F.lit(K.CJK_SINGLE)))).otherwise(empty)
        phrase = F.when(many & (F.length(r) <= 8) & ~r.rlike(edge), F.array(_pair(r, F.lit(K.CJK_PHRASE)))).otherwise(empty)
        keys = F.when(many, F.transform(F.regexp_extract_all(r, F.lit(f"([{K.CHINESE_KEY}])")), lambda c: _pair(c, F.lit(K.CJK_KEY)))).otherwise(empty)
        out = [single, phrase, keys]
        out += [F.when(many, weighted_grams(r, n, tenths)).otherwise(empty) for n, tenths in K.CJK_GRAMS.items()]
        return F.concat(*out)

    return F.flatten(F.transform(runs, of_run))


def feature_rows(normalized: Column) -> Column:
    return F.concat(latin_features(normalized), F.when(normalized.rlike(CJK_LETTER), cjk_features(normalized)).otherwise(F.array().cast(TERM)))


def distinct_features(normalized: Column) -> Column:
    """The number of distinct terms among `feature_rows`."""
    latin = F.regexp_extract_all(normalized, F.lit("([A-Za-z0-9_][A-Za-z0-9_./:+#@-]*[A-Za-z0-9_])"))
    plain = F.size(F.array_except(F.split(F.lower(F.array_join(latin, " ")), " "), F.array(*[F.lit(x) for x in ["", *K.ENGLISH_STOP]])))
    return F.when(normalized.rlike(CJK_LETTER), F.size(F.array_distinct(F.transform(feature_rows(normalized), lambda f: f["term"])))).otherwise(plain)


_LATIN, _DIGIT, _RUN = re.compile(K.LATIN), re.compile("[0-9]"), re.compile(f"{CJK_LETTER}+")
_ENGLISH, _CHINESE, _KEY, _EDGE = frozenset(K.ENGLISH_STOP), frozenset(K.CHINESE_STOP), frozenset(K.CHINESE_KEY), frozenset(K.CHINESE_EDGE)
#: What Latin tokens of KNOWN_CHARS characters or fewer give, for at most KNOWN tokens a worker.
KNOWN, KNOWN_CHARS = 1 << 17, 40
_known: dict[str, tuple[str, int] | None] = {}
#: Rows of one batch of term lists.
LISTS_AT_ONCE = 512
TERM_NAMES = ("term", "tenths")


def _latin_term(raw: str) -> tuple[str, int] | None:
    clean = raw.strip(K.LATIN_EDGE).lower()
    if len(clean) < 2 or clean in _ENGLISH:
        return None
    marked = "." in raw or "_" in raw or raw.isupper() or _DIGIT.search(clean)
    return clean, (K.LATIN_LONG if len(clean) >= 4 else K.LATIN_SHORT) + (K.LATIN_MARKED if marked else 0)


def _cjk_terms(runs: list[str], out: dict[str, int]) -> None:
    def add(t: str, tenths: int) -> None:
        out[t] = out.get(t, 0) + tenths

    many = [r for r in runs if len(r) > 1]
    for r in runs:
        if len(r) == 1 and r in _KEY:
            add(r, K.CJK_SINGLE)
        elif 1 < len(r) <= 8 and _EDGE.isdisjoint(r):
            add(r, K.CJK_PHRASE)
    for c, n in Counter("".join(many)).items():
        if c in _KEY:
            add(c, n * K.CJK_KEY)
    for size, tenths in K.CJK_GRAMS.items():
        grams = Counter(r[i : i + size] for r in many for i in range(len(r) - size + 1))
        for g, n in grams.items():
            if g[0] not in _EDGE and g[-1] not in _EDGE and g not in _CHINESE and sum(c not in _EDGE for c in g) >= max(1, size - 1):
                add(g, n * tenths)


def text_terms(normalized: str | None) -> dict[str, int]:
    """The distinct features of a normalised text with their tenths, those of `feature_rows`."""
    out: dict[str, int] = {}
    if not normalized:
        return out
    for raw, n in Counter(_LATIN.findall(normalized)).items():
        try:
            found = _known[raw]
        except KeyError:
            found = _latin_term(raw)
            if len(raw) <= KNOWN_CHARS:
                if len(_known) >= KNOWN:
                    _known.clear()
                _known[raw] = found
        if found:
            out[found[0]] = out.get(found[0], 0) + n * found[1]
    if not normalized.isascii() and (runs := _RUN.findall(normalized)):
        _cjk_terms([r for r in runs if r not in _CHINESE], out)
    return out


def heaviest(terms: dict[str, int], most: int) -> list[tuple[str, int]]:
    """(term, tenths) of the heaviest terms; of equal ones the longer first, then by code points."""
    least = sorted(terms.values(), reverse=True)[most - 1] if len(terms) > most else 0
    return [(t, -w) for w, _, t in sorted([(-w, -len(t), t) for t, w in terms.items() if w >= least])[:most]]


def texts_of(column: pa.Array) -> list[str | None]:
    return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def lists_array(lists: list[list[tuple[str, int]]]) -> pa.Array:
    """array<struct<term, tenths>> of lists of terms."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    flat = [pa.array([t for x in lists for t, _ in x], pa.string()), pa.array([w for x in lists for _, w in x], pa.int64())]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, list(TERM_NAMES)))


def _of_keys(docs: DataFrame, keys: list[str], text: str, name: str, kind: str, item: Callable[[dict[str, int]], object], packed: Callable[[list], pa.Array], dealt: bool = True) -> DataFrame:
    """(keys, name): `item` of the features of the normalised texts of each key, where there are any; `packed` makes a column of items.

    Texts are dealt by their keys once and lie there by key; term rows are neither exchanged nor made. If `dealt` is
    false, texts stay where they are read, and rows of one key that are not neighbours have their own items.
    """
    rows = docs.select(*keys, F.col(text).alias("_text"))
    if dealt:
        rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, own, items, key, have = [], [], [], None, {}

        def taken() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in own], t) for i, t in enumerate(types)]
            out = pa.RecordBatch.from_arrays([*columns, packed(items)], names=[*keys, name])
            own.clear(), items.clear()
            return out

        def close() -> None:
            if have:
                own.append(key)
                items.append(item(have))

        for batch in batches:
            types = [batch[c].type for c in keys]
            for k, x in zip(zip(*[batch[c].to_pylist() for c in keys]), texts_of(batch["_text"])):
                found = text_terms(x)
                if k == key:
                    for t, w in found.items():
                        have[t] = have.get(t, 0) + w
                else:
                    close()
                    key, have = k, found
                if len(own) >= LISTS_AT_ONCE:
                    yield taken()
        close()
        if own:
            yield taken()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.mapInArrow(run, f"{fields}, {name} {kind}")


def term_lists(docs: DataFrame, keys: list[str], text: str, max_terms: int) -> DataFrame:
    """(keys, terms): the `max_terms` heaviest features of the normalised texts of each key, in order, where there are any."""
    return _of_keys(docs, keys, text, "terms", TERM, lambda have: heaviest(have, max_terms), lists_array)


def _hashed(terms: dict[str, int]) -> np.ndarray:
    return np.sort(pd.util.hash_array(np.array(list(terms), object), categorize=False).view(np.int64))


def _sets_array(sets: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))


def term_sets(docs: DataFrame, keys: list[str], text: str, dealt: bool = True) -> DataFrame:
    """(keys, hashes): all features of the normalised texts of each key, as 64-bit hashes that ascend, where there are any."""
    return _of_keys(docs, keys, text, "hashes", "array<long>", _hashed, _sets_array, dealt)


def top_terms(weighted: DataFrame, keys: list[str], max_terms: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc("weight"), F.desc(F.length("term")), "term")
    return weighted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_terms)


def postings(docs: DataFrame, keys: list[str], text: str, max_terms: int) -> DataFrame:
    """(keys, term, weight, rank): the `max_terms` heaviest features of each normalised text.

    Texts are dealt by their keys once; counting and ranking of their terms then need no exchange of term rows.
    """
    rows = term_lists(docs, keys, text, max_terms).select(*keys, F.posexplode("terms").alias("_at", "_t"))
    return rows.select(*keys, F.col("_t.term").alias("term"), (F.col("_t.tenths") / 10).alias("weight"), (F.col("_at") + 1).alias("rank"))


def query_features(queries: DataFrame, keys: list[str], text: str, max_terms: int = 64) -> DataFrame:
    """Features of normalised queries with the bilingual expansion; added terms weigh less if the query names anchors."""
    low = F.lower(F.col(text))
    base = queries.select(*keys, F.explode(feature_rows(F.col(text))).alias("f")).select(*keys, "f.term", (F.col("f.tenths") * 100).alias("milli"))
    fire = queries.withColumn("_w", F.when(F.size(strong_anchors(low)) > 0, 550).otherwise(1000))
    added = []
    for cues, terms in K.EXPANSIONS:
        own = []
        for t in terms.split("|"):
            own.append((t, 1000))
            if all("㐀" <= c <= "鿿" for c in t) and len(t) >= 2:
                own += [(t[i : i + n], w) for n, w in ((2, 300), (3, 420)) for i in range(len(t) - n + 1)]
        own = [(t, w) for t, w in own if t not in K.CHINESE_STOP and t not in K.ENGLISH_STOP]
        hit = F.greatest(*[F.contains(low, F.lit(c)) for c in cues.split(" ")]) if len(cues.split(" ")) > 1 else F.contains(low, F.lit(cues))
        added.append(F.when(hit, F.array(*[F.struct(F.lit(t).alias("term"), F.lit(w).alias("w")) for t, w in own])).otherwise(F.array().cast("array<struct<term:string,w:int>>")))
    grown = fire.select(*keys, "_w", F.explode(F.concat(*added)).alias("a")).select(*keys, F.col("a.term").alias("term"), (F.col("a.w") * F.col("_w") / 1000).alias("milli"))
    total = base.withColumn("milli", F.col("milli").cast("double")).unionByName(grown).groupBy(*keys, "term").agg(F.sum("milli").alias("milli"))
    return top_terms(total.select(*keys, "term", F.round(F.col("milli") / 1000, 9).alias("weight")), keys, max_terms).drop("rank")


# ---- Bloom sketches: 512 bits, two per term ----

BITS = 512


def sketch_positions(terms: DataFrame, person: bytes = b"") -> DataFrame:
    """Adds `bits` to a table of distinct terms; the hash is the only step outside the JVM. `person` salts the hash."""

    def bits(s: pd.Series) -> pd.Series:
        def of(t: str) -> list[int]:
            d = hashlib.blake2b(t.encode(), digest_size=16, person=person).digest()
            return [int.from_bytes(d[i : i + 4], "little") % BITS for i in (0, 4)]

        return s.map(of)

    return terms.withColumn("bits", F.pandas_udf(bits, "array<int>")("term"))


def sketches(posted: DataFrame, keys: list[str], person: bytes = b"") -> DataFrame:
    """(keys, sketch): the set bits of each document, ascending."""
    bits = sketch_positions(posted.select("term").distinct(), person)
    return posted.join(bits, "term").groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("bits")))).alias("sketch"))


def maybe_contains(sketch: Column, bits: Column) -> Column:
    return F.forall(bits, lambda b: F.array_contains(sketch, b))
