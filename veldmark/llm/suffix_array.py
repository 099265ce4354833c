"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Level 0 works on bytes: suffixes are classified, leftmost-smaller (LMS) substrings sorted by inducing, named, and
sorted as the string of their names; then all suffixes are induced from them. Inducing
visits the buckets in order and moves all entries of a bucket that are known so far at once, so
its work is linear and vectorised where buckets are few (bytes). Strings of names, where buckets are many
and small, are sorted by prefix doubling.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S type); the last entry is the sentinel."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    nxt = np.minimum(np.searchsorted(change, np.arange(n - 1)), len(change) - 1)
    s = np.ones(n, bool)
    s[:-1] = t[change[nxt]] < t[change[nxt] + 1]
    return s


def _groups(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stable order, group values, group counts, rank inside the group in that order)."""
    order = np.argsort(chars.astype(np.uint16), kind="stable")  # a radix sort; there are 1024 characters at most
    c = chars[order]
    starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    counts = np.diff(np.r_[starts, len(c)])
    return order, c[starts], counts, np.arange(len(c)) - np.repeat(starts, counts)


def _induce_blocks(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n, ends = len(t), np.cumsum(sizes)
    heads = ends - sizes
    sa = np.full(n, -1, np.int64)
    order, values, counts, rank = _groups(t[lms])
    n_lms = np.zeros(len(sizes), np.int64)
    n_lms[values] = counts
    sa[np.repeat(ends[values] - counts, counts) + rank] = lms[order]
    ptr = heads.copy()

    def left(chunk):
        j = chunk[chunk > 0] - 1
        j = j[~s[j]]
        if len(j):
            order, values, counts, rank = _groups(t[j])
            sa[np.repeat(ptr[values], counts) + rank] = j[order]
            ptr[values] += counts

    used = np.flatnonzero(sizes)
    for c in used:
        at = heads[c]
        while at < ptr[c]:
            at, end = ptr[c], at
            left(sa[end:at].copy())
        if n_lms[c]:
            left(sa[ends[c] - n_lms[c] : ends[c]].copy())
    l_end, ptr = ptr, ends.copy()

    def right(chunk):  # the chunk is read from its end
        j = chunk[::-1]
        j = j[j > 0] - 1
        j = j[s[j]]
        if len(j):
            order, values, counts, rank = _groups(t[j])
            sa[np.repeat(ptr[values], counts) - 1 - rank] = j[order]
            ptr[values] -= counts

    for c in used[::-1]:
        at = ends[c]
        if c == 0:  # the sentinel
            sa[0], ptr[0] = n - 1, 0
        while ptr[c] < at:
            at, end = ptr[c], at
            right(sa[at:end].copy())
        if l_end[c] > heads[c]:
            right(sa[heads[c] : l_end[c]].copy())
    return sa


def _double(t: np.ndarray) -> np.ndarray:
    """By prefix doubling: ranks by 1, 2, 4, ... symbols, of the suffixes that are not alone in their rank yet."""
    sa = np.argsort(t, kind="stable")
    n, rank, place, key, step = len(t), np.empty(len(t), np.int64), np.arange(len(t)), t[sa].astype(np.int64), 1
    while True:
        head = np.r_[True, key[1:] != key[:-1]]
        rank[sa[place]] = place[np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))]
        place = place[~(head & np.r_[head[1:], True])]
        if not len(place):
            return sa
        i = sa[place]
        key = rank[i] * n + rank[i + step]  # the last symbol is the only one of its kind, so equal prefixes end before it
        order = np.argsort(key)
        sa[place], key = i[order], key[order]
        step *= 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of integers whose last is 0 and the only 0."""
    n = len(t)
    if n <= 2:
        return np.arange(n - 1, -1, -1, dtype=np.int64)
    sizes = np.bincount(t)
    if len(sizes) > 1024:
        return _double(t)
    s = classify(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s[1:] & ~s[:-1]
    lms = np.flatnonzero(is_lms)
    sa = _induce_blocks(t, s, lms, sizes)
    ordered = sa[is_lms[sa]]
    following = np.full(n, n - 1)
    following[lms[:-1]] = lms[1:]
    a, b = ordered[:-1], ordered[1:]
    la, lb = following[a] - a, following[b] - b
    same = (la == lb) & (a != n - 1) & (b != n - 1)
    at = np.flatnonzero(same)
    step = 0
    while len(at):  # compare the LMS substrings of neighbours symbol by symbol
        i, j = a[at] + step, b[at] + step
        differ = (t[i] != t[j]) | (s[i] != s[j])
        same[at[differ]] = False
        at = at[~differ]
        at = at[la[at] > step]
        step += 1
    names = np.zeros(n, np.int64)
    names[ordered] = np.cumsum(np.r_[0, ~same])
    reduced = names[lms]
    if reduced.max() + 1 < len(lms):
        order = suffix_array(reduced)
    else:
        order = np.empty(len(lms), np.int64)
        order[reduced] = np.arange(len(lms))
    return _induce_blocks(t, s, lms[order], sizes)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """For each position, symbols (``limit`` at most) that its suffix shares with the one before it in the array.

    Found in text order from the predecessor of each position by halving steps over prefix hashes.
    """
    n = len(t)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    power = np.ones(n + 1, np.uint64)
    power[1:] = np.multiply.accumulate(np.full(n, 0xD6E8FEB86659FD93, np.uint64))
    sums = np.zeros(n + 1, np.uint64)
    sums[1:] = np.cumsum(_mixed(t) * power[:-1], dtype=np.uint64)
    out = np.zeros(n, np.int64)
    have = before >= 0
    i = np.flatnonzero(have)
    j, got, step = before[i], np.zeros(len(i), np.int64), 1 << (limit.bit_length() - 1)
    while step:
        to = got + step
        ok = (to <= limit) & (i + to <= n) & (j + to <= n)
        x, y, e = np.minimum(i, j), np.maximum(i, j), np.where(ok, to, 0)
        ok &= (sums[x + e] - sums[x]) * power[y - x] == sums[y + e] - sums[y]
        got = np.where(ok, to, got)
        step >>= 1
    out[i] = got
    return out
