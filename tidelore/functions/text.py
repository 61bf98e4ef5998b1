"""Text functions as Column expressions; they stay in the JVM but for Unicode folding."""

from __future__ import annotations

import operator
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import constants as K

_SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"
CJK_LETTER = "[㐀-䶿一-鿿]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_SPACE}|{_SPACE}\z", "")


def normalize_text(c: Column) -> Column:
    """Line ends, blanks and blank lines folded, ends stripped. Expects text in NFKC (see `with_normalized`)."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def _nfkc(c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.pandas_udf(run, "string")(c)


def with_normalized(df: DataFrame, source: str, out: str) -> DataFrame:
    """Adds the normalised text; only rows with other than ASCII letters pass through Python."""
    plain = ~F.coalesce(F.col(source).rlike(r"[^\x00-\x7F]"), F.lit(False))
    ascii_rows = df.filter(plain).withColumn(out, normalize_text(F.col(source)))
    return ascii_rows.unionByName(df.filter(~plain).withColumn(out, normalize_text(_nfkc(F.col(source)))))


def sentences(normalized: Column) -> Column:
    parts = F.split(normalized, r"(?<=[。！？!?])\s*|(?<=[.])\s+(?=[A-Z0-9])|\n+")
    return F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" \t-•"))), lambda p: F.length(p) >= 8)


def estimate_tokens(c: Column) -> Column:
    """CJK letters, and a quarter of the rest, rounded up; at least 1."""
    cjk = F.length(F.regexp_replace(c, "[^㐀-鿿]", ""))
    return F.greatest(F.lit(1), cjk + F.ceil((F.length(c) - cjk) / 4)).cast("long")


def fingerprint(normalized: Column) -> Column:
    return F.sha2(normalized, 256)


def latin_tokens(c: Column) -> Column:
    """Structs (raw, clean) of the Latin tokens of a case-preserved text."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"({K.LATIN})")), lambda t: F.struct(t.alias("raw"), F.lower(F.btrim(t, F.lit(K.LATIN_EDGE))).alias("clean")))


def is_upper(c: Column) -> Column:
    return c.rlike("[A-Z]") & ~c.rlike("[a-z]")


def _quoted(normalized: Column) -> Column:
    spans = F.transform(F.regexp_extract_all(normalized, F.lit("[\"“‘']([^\"”’']{3,80})[\"”’']")), lambda q: F.lower(normalize_text(q)))
    return F.filter(spans, lambda q: q != "")


def strong_anchors(normalized: Column) -> Column:
    """Distinct explicit identifiers and quoted spans."""
    marked = F.filter(latin_tokens(normalized), lambda t: (t["clean"] != "") & ((F.length(t["clean"]) >= 5) | t["clean"].rlike("[0-9]") | t["raw"].rlike("[._]") | is_upper(t["raw"])))
    return F.array_union(F.transform(marked, lambda t: t["clean"]), _quoted(normalized))


#: A Latin token of five characters or more, with a digit, `_` or `.`, or without small letters.
_MARKED = r"[A-Za-z0-9_][A-Za-z0-9_./:+#@-]{3,}[A-Za-z0-9_]|[0-9_]|[A-Za-z][/:+#@-]*\.|(?<![A-Za-z0-9_./:+#@-])[./:+#@-]*+[A-Z][A-Z./:+#@-]*+(?![A-Za-z])"


def has_anchor(normalized: Column) -> Column:
    """Whether `strong_anchors` finds any, without listing them."""
    return normalized.rlike(_MARKED) | (normalized.rlike("[\"“‘']") & (F.size(_quoted(normalized)) > 0))


def anchor_ratio(anchors: Column, normalized: Column) -> Column:
    low = F.lower(normalized)
    return F.when(F.size(anchors) == 0, 1.0).otherwise(F.size(F.filter(anchors, lambda a: F.contains(low, a))) / F.size(anchors))


def anchor_factor(anchors: Column, normalized: Column) -> Column:
    r = anchor_ratio(anchors, normalized)
    return F.when(F.size(anchors) == 0, 1.0).when(r <= 0, 0.10).otherwise(0.65 + 2.35 * r)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct terms: 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def looked_up(key: Column, values: dict[str, float], default: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(table, key), F.lit(default))


def any_cue(low: Column, cues: str) -> Column:
    """Whether the text contains one of the cues; looking for each costs less than one expression of alternatives."""
    return reduce(operator.or_, [F.contains(low, F.lit(c)) for c in cues.split("|")])


def media_type(mime: Column, filename: Column) -> Column:
    low = F.lower(filename)
    return (
        F.when(mime.startswith("image/"), "image")
        .when(mime.startswith("audio/"), "audio")
        .when(mime.startswith("video/"), "video")
        .when((mime == "application/pdf") | low.endswith(".pdf"), "pdf")
        .when(mime.startswith("text/") | low.rlike(r"\.(md|txt|py|json|ya?ml|csv|tex)$"), "text")
        .otherwise("binary")
    )


def normalize_role(role: Column) -> Column:
    known = F.element_at(F.create_map(*[F.lit(x) for kv in K.ROLES.items() for x in kv]), F.lower(strip(role)))
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unsupported role: "), F.coalesce(role, F.lit("null")))))
