"""Words of many texts at once, as 64-bit hashes, and the terms that a fitted set of texts holds.

A word is a run of letters and digits of the lower-cased text. A term is a word or one of its prefixes of 4 to 6
letters. Terms are told apart by 64-bit hashes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .common import mix64

PREFIXES = (4, 5, 6)
#: Code points that are hashed at once.
STRETCH = 1 << 18

_BASE = np.uint64(0x5851F42D4C957F2D)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PREFIX = np.uint64(0xA24BAED4963EE407)
_BUCKET_BITS = 20


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its hash, and whether it is a letter or digit."""
    codes = mix64(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return codes, np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(STRETCH + 512)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _pieces(texts: list[str]) -> Iterator[tuple[int, str]]:
    """(text, piece): lower-cased texts, the long ones cut where no word is."""
    for d, text in enumerate(texts):
        text = text.lower()
        a = 0
        while len(text) - a > STRETCH:
            b = a + STRETCH
            while b > a and text[b - 1].isalnum():
                b -= 1
            if b == a:  # one word fills the stretch
                b = a + STRETCH
                while b < len(text) and text[b].isalnum():
                    b += 1
            yield d, text[a:b]
            a = b
        yield d, text[a:] if a else text


def _stretches(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    docs, held, size = [], [], 0
    for d, piece in _pieces(texts):
        if held and size + len(piece) >= STRETCH:
            yield np.array(docs), held
            docs, held, size = [], [], 0
        docs.append(d)
        held.append(piece)
        size += len(piece) + 1
    if held:
        yield np.array(docs), held


def words(texts: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Per stretch of text: the text of each word, and its hashes: of the whole word, then of its prefixes from the
    longest to the shortest (0 where the word is shorter)."""
    codes, alnum = _letters()
    for docs, held in _stretches(texts):
        points = np.frombuffer("\n".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            continue
        word = np.concatenate([[False], alnum[points], [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        a, b = edge[::2], edge[1::2]
        up, down = _usual_powers() if len(points) <= STRETCH + 512 else _powers(len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(codes[points] * up[: len(points)], out=sums[1:])
        own, back = sums[a], down[a]
        hashes = [mix64((sums[b] - own) * back)]
        for n in PREFIXES[::-1]:
            cut = mix64((sums[np.minimum(a + n, len(points))] - own) * back + _PREFIX)
            hashes.append(np.where(b - a >= n, cut, np.uint64(0)))
        ends = np.cumsum([len(x) + 1 for x in held])
        yield docs[np.searchsorted(ends, a, "right")], hashes


def distinct_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, its next shorter prefix or 0), each term of a text once."""
    doc, term, parent = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for d, hashes in words(texts):
        below = np.zeros(len(d), np.uint64)
        for h in hashes[::-1]:
            there = h != 0
            doc.append(d[there])
            term.append(h[there])
            parent.append(below[there])
            below = np.where(there, h, below)
    doc, term, parent = np.concatenate(doc), np.concatenate(term), np.concatenate(parent)
    order = np.lexsort((term, doc))
    doc, term, parent = doc[order], term[order], parent[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    return doc[new], term[new], parent[new]


class Lexicon:
    """Numbers of known terms: their places in `hashes` (ascending). `parent` leads from a term to its next shorter
    prefix, which is known too, or to -1."""

    def __init__(self, hashes: np.ndarray, parent: np.ndarray) -> None:
        self.hashes, self.parent = hashes, parent
        self.first = np.searchsorted(hashes >> np.uint64(64 - _BUCKET_BITS), np.arange((1 << _BUCKET_BITS) + 1, dtype=np.uint64)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        bucket = (h >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(h), -1, np.int64)
        left = np.flatnonzero(at < end)
        at, end, h = at[left], end[left], h[left]
        while len(left):
            hit = self.hashes[at] == h
            out[left[hit]] = at[hit]
            on = ~hit & (at + 1 < end)
            left, at, end, h = left[on], at[on] + 1, end[on], h[on]
        return out

    def _units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(key, times): text and longest known term of each word, packed into one key, and how often it occurs."""
        width = max(1, len(self))
        keys = [np.zeros(0, np.int64)]
        for d, hashes in words(texts):
            unit = self.find(hashes[0])
            for h in hashes[1:]:  # the longest known prefix of words that no fitted text holds
                rest = np.flatnonzero((unit < 0) & (h != 0))
                unit[rest] = self.find(h[rest])
            known = unit >= 0
            keys.append(d[known] * width + unit[known])
        key = np.sort(np.concatenate(keys))
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return key[first], np.diff(np.append(first, len(key)))

    def presence(self, texts: list[str]) -> np.ndarray:
        """In how many of the texts each known term occurs."""
        width = max(1, len(self))
        key, _ = self._units(texts)
        own = [key]
        while len(key):
            up = self.parent[key % width]
            key = key[up >= 0] // width * width + up[up >= 0]
            key = key[np.diff(key, prepend=-1) != 0]  # words of one stem are often neighbours
            own.append(key)
        key = np.sort(np.concatenate(own))
        return np.bincount(key[np.diff(key, prepend=-1) != 0] % width, minlength=len(self))

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, times) of the known terms of some texts, by text and term."""
        width = max(1, len(self))
        key, times = self._units(texts)
        own, held, n = [key], [times], times
        while len(key):
            up = self.parent[key % width]
            on = up >= 0
            key, n = key[on] // width * width + up[on], n[on]
            own.append(key)
            held.append(n)
        key, times = np.concatenate(own), np.concatenate(held)
        order = np.argsort(key)
        key, times = key[order], times[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.add.reduceat(times, first) if len(first) else times
        key = key[first]
        return key // width, key % width, times
