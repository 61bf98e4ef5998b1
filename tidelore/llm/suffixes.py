"""Two-stage suffix sorting in NumPy.

Only suffixes smaller than their successors are sorted directly; the others are induced by one scan over
the buckets of first bytes, from low to high. Adjacent common prefixes then group equal strings.
"""

from __future__ import annotations

import numpy as np


def _words(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number (zeros past the end)."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    n = len(text) + depth + 8
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + n]
    return out


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the end counts as lowest."""
    n = len(text)
    nxt = np.append(text[1:], np.uint8(0)).astype(np.int16)
    diff = np.sign(nxt - text)
    diff[-1] = -1
    at = np.where(diff != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next position that differs from its successor
    return diff[at] > 0


def suffix_order(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """All positions of `text` (uint8) ordered by their first `depth` bytes at least; later ties are in any order."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    words = _words(text, depth) if words is None else words
    small = smaller_than_successor(text)
    # First stage: direct sort, eight bytes at a time, only among what is still tied.
    sa = np.flatnonzero(small)
    sa = sa[np.argsort(words[sa], kind="stable")]
    if len(sa):
        key = words[sa]
        group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        for skip in range(8, depth, 8):
            same = group[1:] == group[:-1]
            tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
            if not len(tied):
                break
            own, g = sa[tied], group[tied]
            nxt = words[own + skip]
            order = np.lexsort((nxt, g))
            own, nxt = own[order], nxt[order]
            sa[tied] = own
            fresh = np.zeros(len(sa), bool)
            fresh[1:] = ~same
            inner = np.flatnonzero((g[1:] == g[:-1]) & (nxt[1:] != nxt[:-1])) + 1
            fresh[tied[inner]] = True
            group = np.cumsum(fresh)
    # Second stage: buckets by first byte, induced suffixes before directly sorted ones.
    counts = np.bincount(text, minlength=256)
    starts = np.concatenate([[0], np.cumsum(counts)])
    head = starts[:-1].copy()
    out = np.full(n, -1, np.int64)
    first = text[sa]
    n_small = np.bincount(first, minlength=256)
    at_small = np.concatenate([[0], np.cumsum(n_small)])
    for c in np.flatnonzero(n_small):
        out[starts[c + 1] - n_small[c] : starts[c + 1]] = sa[at_small[c] : at_small[c + 1]]
    large = ~small

    def induce(found: np.ndarray) -> None:
        found = found[text[found].argsort(kind="stable")]
        chars, at, k = np.unique(text[found], return_index=True, return_counts=True)
        for ch, a, m in zip(chars, at, k):
            out[head[ch] : head[ch] + m] = found[a : a + m]
            head[ch] += m

    if large[n - 1]:
        induce(np.array([n - 1]))  # its successor is the empty suffix, the lowest
    for c in np.flatnonzero(counts):
        lo = starts[c]
        while lo < head[c]:  # runs of the same byte induce within the bucket
            got = out[lo : head[c]]
            lo = head[c]
            prev = got[got > 0] - 1
            prev = prev[large[prev] & (text[prev] == c)]
            if len(prev):
                out[head[c] : head[c] + len(prev)] = prev
                head[c] += len(prev)
        prev = out[starts[c] : starts[c + 1]]
        prev = prev[prev > 0] - 1
        prev = prev[large[prev] & (text[prev] > c)]
        if len(prev):
            induce(prev)
    return out


def equal_prefixes(order: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    """Whether each suffix of `order` (but the first) has a common prefix of `size` bytes or more with the one before it."""
    a, b = order[1:], order[:-1]
    same = np.ones(len(a), bool)
    for skip in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        same[same] = words[a[same] + skip] == words[b[same] + skip]
    return same


def smallest_owner(text: np.ndarray, starts: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """For each of `starts`, the least `owner` among all starts of an equal string of `size` bytes.

    `text` is uint8 without the byte 0 but for separators; a string from a start never crosses one.
    """
    words = _words(text, size + 8)
    rank = np.full(len(text), -1, np.int64)
    rank[starts] = np.arange(len(starts))
    order = rank[suffix_order(text, size, words)]
    order = order[order >= 0]
    if not len(order):
        return owner[:0]
    new = np.r_[True, ~equal_prefixes(starts[order], words, size)]
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(owner[order], first)
    out = np.empty(len(starts), owner.dtype)
    out[order] = np.repeat(least, np.diff(np.r_[first, len(order)]))
    return out
