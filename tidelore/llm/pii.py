"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the text: at-signs, plus signs, digits,
URL schemes and identifier cues. Each anchor has a deterministic local parser, which expands to
the boundaries of the span and validates it. Spans of a kind don't overlap: an anchor inside the last stretch that its
kind has read is not expanded again, so the work is in proportion to the text.

Cases: a null text counts as empty and has no span; texts of any length are read whole; repeated
rows and ids each get their own row; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Kinds of the contract, in the order that breaks ties; the method adds the later ones.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "secret")
COUNTS = tuple(f"n_{k}" for k in KINDS)
ORDER = {k: i for i, k in enumerate(KINDS)}

DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
COLON_BLANK = frozenset(": ")
#: Characters of an access key, cue included.
KEY = 20
#: Identifier cues, matched as they stand here, and what each announces.
CUES = {"AKIA": "key", "password=": "value", "passwd=": "value", "api_key=": "value", "token=": "value", "IBAN": "iban"}
SCHEMES = ("http://", "https://", "ftp://", "mailto:")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for c, kind in CUES.items():
        a.add_word(c, (kind, len(c)))
    a.make_automaton()
    return a


def _run(text: str, i: int, allowed: frozenset[str], most: int | None = None) -> int:
    """Where the run of allowed characters from i on ends, looked for up to `most`."""
    n = len(text) if most is None else min(len(text), most)
    while i < n and text[i] in allowed:
        i += 1
    return i


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (stop := _run(text, end + 1, LABEL)) > end + 1:
        end, dots = stop, dots + 1
    return (start, end) if dots else None


def _groups(text: str, i: int, seps: str) -> tuple[list[tuple[int, int]], int]:
    """Digit runs from i on that single separators join, and where the chain ends."""
    runs, end = [], i
    while True:
        stop = _run(text, i, DIGITS)
        if stop == i:
            return runs, end
        runs.append((i, stop))
        end = stop
        if stop >= len(text) or text[stop] not in seps:
            return runs, end
        i = stop + 1


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    end = _run(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return (plus, end) if end > plus + 3 and text[end - 1] in DIGITS else None


def find_spans(text: str, scan: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start, then in the order of KINDS."""
    out: list[tuple[str, int, int]] = []
    email_end = ip_end = card_end = phone_end = url_end = value_end = 0
    for last, (kind, size) in scan.iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= ip_end and (at == 0 or text[at - 1] not in DIGITS or at == ip_end):
                runs, end = _groups(text, at, ".")
                ip_end = max(end, at + 1)
                for k in range(0, len(runs) - 3, 4):
                    four = runs[k : k + 4]
                    if all(len(text[a:b].lstrip("0")) < 4 and int(text[a:b]) <= 255 for a, b in four):
                        out.append(("ip", four[0][0], four[3][1]))
            if at >= card_end:
                runs, end = _groups(text, at, " -")
                card_end = max(end, at + 1)
                digits = "".join(text[a:b] for a, b in runs) if end - at >= 12 else ""
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", at, end))
        elif kind == "at":
            if at >= email_end and (span := _email(text, at, email_end)):
                out.append(("email", *span))
                email_end = span[1]
        elif kind == "plus":
            if at >= phone_end and (span := _phone(text, at)):
                phone_end = span[1]
                if 9 <= sum(c in DIGITS for c in text[span[0] : span[1]]) <= 15:
                    out.append(("phone", *span))
        elif kind == "scheme":
            if at < url_end:
                continue
            end = last + 1
            while end < len(text) and not text[end].isspace() and text[end] not in "<>\"'":
                end += 1
            url_end = end
            while end > last + 1 and text[end - 1] in ".,;:!?)":
                end -= 1
            if end > last + 1:
                out.append(("url", at, end))
        elif kind == "key":
            if at and text[at - 1] in ALNUM:
                continue
            if _run(text, last + 1, ALNUM, at + KEY + 1) == at + KEY:
                out.append(("secret", at, at + KEY))
        elif kind == "value":
            if at < value_end:
                continue
            end = last + 1
            while end < len(text) and not text[end].isspace():
                end += 1
            value_end = end
            if end > last + 1:
                out.append(("secret", at, end))
        elif kind == "iban":
            start = _run(text, last + 1, COLON_BLANK)
            end = _run(text, start, ALNUM, start + 35)
            if 15 <= end - start <= 34 and iban(text[start:end]):
                out.append(("iban", start, end))
    out.sort(key=lambda s: (s[1], ORDER[s[0]], s[2]))
    return out


def iban(code: str) -> bool:
    """Whether the check digits hold (remainder 1 modulo 97)."""
    if not (code[:2].isalpha() and code[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in (code[4:] + code[:4]).upper())) % 97 == 1


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names the whole."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:] if out else text


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, a count of each kind, the digest of the base spans, all spans, and how many of them are
    personal data or secrets (n_personal: all kinds but URLs)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = automaton()
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                spans = find_spans(text, scan)
                n = Counter(s[0] for s in spans)
                base = joined([s for s in spans if s[0] in BASE])
                rows.append((i, *(n[k] for k in KINDS), len(spans) - n["url"], hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
            out = pd.DataFrame(rows, columns=["doc_id", *COUNTS, "n_personal", "base_sha256", "spans"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(
        run, f"doc_id long, {counts}, n_personal long, base_sha256 string, spans string"
    )


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, personal data in the text replaced; a null text stays null, an empty one empty. Each row
    is masked by itself, whatever its id."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan = automaton()
        for s in texts:
            yield s.map(lambda t: None if t is None else mask(t, find_spans(t, scan)))

    return docs.withColumn(text_col, F.pandas_udf(run, "string")(F.col(text_col)))
