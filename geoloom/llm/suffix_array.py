"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than the one after them.
The leftmost S suffixes of each stretch start the substrings that are sorted
first: one induction orders them, equal ones get equal names, and the string of
names is sorted recursively. A second induction places all suffixes.

Induction goes bucket by bucket. What a bucket holds at the time is one wave: the
suffixes one to the left of it go, in order, to the fronts (L) or the backs (S) of
their own buckets. Waves are arrays, so that bytes take a few hundred of them
however long the text is; a string of many names and few suffixes each goes one
suffix at a time. Both are linear but for the wave's stable sort by byte.

A common prefix with the suffix that sorts before shrinks by one from a place to
the next wherever the preceding bytes agree; only the other places are compared.
"""

from __future__ import annotations

import numpy as np

#: Suffixes of a bucket, on average, from which on waves are faster.
BUCKET = 16


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix of ``t`` is smaller than the next one; the last, a unique least, is."""
    n = len(t)
    change = np.where(t[:-1] != t[1:], np.arange(n - 1), n - 1)
    change = np.minimum.accumulate(change[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = t[change] < t[np.minimum(change + 1, n - 1)]
    return out


def _deal(sa: np.ndarray, at: np.ndarray, found: np.ndarray, keys: np.ndarray, step: int) -> None:
    """Put ``found`` in order at the pointers of their buckets, which move on by ``step``."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(firsts, len(keys)))
    inside = np.arange(len(keys)) - np.repeat(firsts, sizes)
    sa[at[keys] + step * inside] = found[order]
    at[keys[firsts]] += step * sizes


def _waves(t: np.ndarray, s: np.ndarray, begins: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n = len(t)
    sa = np.full(n, -1, np.int64)
    n_s = np.bincount(t[s], minlength=len(begins))
    back = ends - 1
    _deal(sa, back, lms[::-1], t[lms[::-1]], -1)
    used = np.flatnonzero(ends > begins).tolist()
    front, given = begins.copy(), back + 1
    for c in used:
        done = begins[c]
        while done < front[c]:
            wave, done = sa[done : front[c]], front[c]
            _left(t, s, False, sa, front, wave, 1)
        if given[c] < ends[c]:
            _left(t, s, False, sa, front, sa[given[c] : ends[c]], 1)
    back = ends - 1
    for c in reversed(used):
        done = ends[c]
        while done > back[c] + 1:
            wave, done = sa[back[c] + 1 : done][::-1], back[c] + 1
            _left(t, s, True, sa, back, wave, -1)
        if n_s[c] < ends[c] - begins[c]:
            _left(t, s, True, sa, back, sa[begins[c] : ends[c] - n_s[c]][::-1], -1)
    return sa


def _left(t, s, kind: bool, sa, at, wave, step) -> None:
    """Deal the suffixes one to the left of a wave that are of the kind."""
    j = wave - 1
    j = j[j >= 0]
    j = j[s[j] == kind]
    if len(j) > 1:
        _deal(sa, at, j, t[j], step)
    elif len(j):
        c = t[j[0]]
        sa[at[c]] = j[0]
        at[c] += step


def _one_by_one(t: np.ndarray, s: np.ndarray, begins: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    text, n = t.tolist(), len(t)
    # the suffix one to the left where it is of the kind, by suffix; the last entry stands for a free place
    left = np.arange(-1, n)
    left[0] = left[n] = -1
    larger, smaller = left.copy(), left.copy()
    larger[1:n][s[:-1]] = -1
    smaller[1:n][~s[:-1]] = -1
    sa = [-1] * n
    back = (ends - 1).tolist()
    for j in lms[::-1].tolist():
        c = text[j]
        sa[back[c]] = j
        back[c] -= 1
    # the lists are filled ahead of where they are read
    front, left = begins.tolist(), larger.tolist()
    for i in sa:
        j = left[i]
        if j >= 0:
            c = text[j]
            p = front[c]
            sa[p] = j
            front[c] = p + 1
    back, left = (ends - 1).tolist(), smaller.tolist()
    for i in reversed(sa):
        j = left[i]
        if j >= 0:
            c = text[j]
            p = back[c]
            sa[p] = j
            back[c] = p - 1
    return np.array(sa, np.int64)


def _names(t: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the substrings from ``order`` to ``ends``, inclusive, which are sorted; equal ones have equal numbers."""
    size = ends - order
    same = np.append(False, size[1:] == size[:-1])
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        equal = t[order[open_] + k] == t[order[open_ - 1] + k]
        same[open_[~equal]] = False
        open_ = open_[equal & (size[open_] > k)]
        k += 1
    return np.cumsum(~same) - 1


def _sorted(t: np.ndarray, keys: int) -> np.ndarray:
    """Suffix array of numbers under ``keys``, the last of which is a unique 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    s = _smaller(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    ends = np.cumsum(np.bincount(t, minlength=keys))
    begins = np.append(0, ends[:-1])
    # a wave costs as much as some suffixes, and a bucket takes two or more
    induce = _waves if BUCKET * keys < n else _one_by_one
    place = np.full(n, -1, np.int64)
    place[lms] = np.arange(len(lms))
    first = induce(t, s, begins, ends, lms)
    order = first[place[first] >= 0]
    until = np.append(lms[1:], n - 1)
    named = np.empty(len(lms), np.int64)
    names = _names(t, order, until[place[order]])
    named[place[order]] = names
    if names[-1] + 1 < len(lms):
        order = lms[_sorted(named, int(names[-1]) + 1)]
    return induce(t, s, begins, ends, order)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of bytes, the last of which is a unique 0."""
    return _sorted(text, 256)


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By place in the text: bytes that each suffix shares with the one that sorts before it."""
    n = len(text)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    out = np.zeros(n, np.int64)
    at = np.arange(n)
    alike = np.zeros(n, bool)
    alike[1:] = (before[1:] > 0) & (text[:-1] == text[before[1:] - 1])
    # eight bytes at a place as one number; zeros follow the end
    padded = np.append(text, np.zeros(16, np.uint8)).astype(np.uint64)
    eight = padded[: n + 8].copy()
    for k in range(1, 8):
        eight |= padded[k : n + 8 + k] << np.uint64(8 * k)
    a = np.flatnonzero(~alike & (before >= 0))
    b, where = before[a], a
    while len(a):
        differ = eight[a] ^ eight[b]
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.floor(np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64) // 8)
        out[where] += equal
        more = equal == 8
        a, b, where = a[more] + 8, b[more] + 8, where[more]
    # one less a place, from the last place that was compared
    ends = np.maximum.accumulate(np.where(alike, -1, at + out))
    return np.where(alike, ends - at, out)
