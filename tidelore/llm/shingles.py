"""Word shingles of many texts at once, as 64-bit hashes, in NumPy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import mix64

_BASE = np.uint64(0x5851F42D4C957F2D)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
CHUNK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(CHUNK)


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its hash; the bytes are read in pieces that end where no word is."""
    word = ~_SPACE[data]
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    at = 0
    while at < len(data):
        stop = min(len(data), at + CHUNK)
        if stop < len(data) and word[stop] and word[stop - 1]:
            back = np.flatnonzero(~word[at:stop])
            if len(back):
                stop = at + int(back[-1]) + 1
            else:  # one word fills the piece
                while stop < len(data) and word[stop]:
                    more = np.flatnonzero(~word[stop : stop + CHUNK])
                    stop = stop + int(more[0]) if len(more) else min(len(data), stop + CHUNK)
        own = word[at:stop]
        first, last = own.copy(), own.copy()
        first[1:] &= ~own[:-1]
        last[:-1] &= ~own[1:]
        bounds = off[(off > at) & (off < stop)] - at
        first[bounds] = own[bounds]
        last[bounds - 1] = own[bounds - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _usual_powers() if stop - at <= CHUNK else _powers(stop - at)
        sums = np.zeros(stop - at + 1, np.uint64)
        np.cumsum(_LETTER[data[at:stop]] * up[: stop - at], out=sums[1:])
        starts.append(a + at)
        hashes.append(mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
        at = stop
    return np.concatenate(starts), np.concatenate(hashes)


def _sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    a, words = _words(data, off)
    doc = np.searchsorted(off, a, "right") - 1
    per = np.bincount(doc, minlength=len(off) - 1)
    at = np.cumsum(per) - per
    m = len(words) - n + 1
    if m > 0:
        h = words[:m].copy()
        for j in range(1, n):
            h = h * _STEP + words[j : j + m]
        whole = doc[:m] == doc[n - 1 :]
        h, d = mix64(h[whole]), doc[:m][whole]
    else:
        h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((per > 0) & (per < n))
    if len(short):
        more = np.empty(len(short), np.uint64)
        for k, s in enumerate(short.tolist()):
            x = np.array([per[s]], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for w in words[at[s] : at[s] + per[s]]:
                x = x * _STEP + w
            more[k] = mix64(x)[0]
        h, d = np.concatenate([h, more]), np.concatenate([d, short])
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    cut = np.searchsorted(d, np.arange(len(off)))
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
        h[s:e].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.bincount(d[new], minlength=len(off) - 1)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's n-word shingles, ascending, end to end, and the offsets of the texts.

    A to Z count as lower case; words are what other bytes than space and tab to carriage return make up.
    A text with fewer than n words has one shingle, all its words; one without words has none.
    """
    hashes, sizes = [], []
    a = 0
    while a < len(off) - 1:  # pieces of about a megabyte keep the temporary arrays small
        b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK, "right")) - 1)
        h, k = _sets(data[off[a] : off[b]], off[a : b + 1] - off[a], n)
        hashes.append(h)
        sizes.append(k)
        a = b
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
