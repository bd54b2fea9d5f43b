"""Suffix arrays of bounded shards by induced sorting, and their permuted common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour; the substrings between leftmost smaller
positions are sorted by one induction, named, and their order found recursively; a last induction then gives the array.
An induction sweeps over the array in steps of many places; what a step induces is placed by one stable sort of symbols.
"""

import numpy as np

#: Places of an array that one step looks at, at most and at least.
MOST, LEAST = 1 << 16, 64


def _place(sa: np.ndarray, t: np.ndarray, j: np.ndarray, head: np.ndarray, way: int) -> None:
    """Put suffixes, in order, at the next free places of their buckets, upwards or downwards."""
    c = t[j]
    order = c.argsort(kind="stable")
    c = c[order]
    n = np.arange(len(c))
    first = n.copy()
    first[1:][c[1:] == c[:-1]] = 0
    at = head[c] + way * (n - np.maximum.accumulate(first))
    sa[at] = j[order]
    head[c] = at + way  # of equal symbols the last one counts


def _sweep(sa: np.ndarray, t: np.ndarray, chosen: np.ndarray, free: np.ndarray, way: int) -> None:
    """Goes over the array, upwards or downwards, and puts the left neighbour of each suffix, if chosen, at the next free
    place of its bucket.

    A step takes as many places as are sure to be settled: up to the nearest place that it may fill itself. So steps are
    long whether buckets are few and large or many and small.
    """
    n = len(t)
    at, width = (0, LEAST) if way > 0 else (n - 1, LEAST)
    while 0 <= at < n:
        seen = sa[at : at + width] if way > 0 else sa[max(at - width + 1, 0) : at + 1][::-1]
        place = ((seen > 0) & chosen[seen - 1]).nonzero()[0]
        j = seen[place] - 1
        ahead = (free[t[j]] - at) * way  # steps from here to where each goes at the nearest
        nearest = np.minimum.accumulate(ahead)
        late = (place[1:] >= nearest[:-1]).nonzero()[0]
        taken = int(late[0]) + 1 if len(late) else len(j)
        if taken:
            _place(sa, t, j[:taken], free, way)
        done = min(len(seen), int(nearest[taken - 1])) if taken else len(seen)
        at += way * done
        width = min(max(2 * done, LEAST), MOST)


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes, from leftmost smaller suffixes in their order."""
    n = len(t)
    sa = np.full(n, -1, np.int64)
    _place(sa, t, lms[::-1], ends - 1, -1)
    head = starts.copy()
    _sweep(sa, t, ~is_s, head, 1)
    sa[np.arange(n) >= np.repeat(head, ends - starts)] = -1  # the smaller suffixes are placed anew
    tail = ends - 1
    sa[0] = n - 1
    _sweep(sa, t, is_s, tail, -1)
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of symbols >= 0 whose last one is smaller than all others."""
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].copy()
    t = t.astype(np.int64) if t.max() > 32767 else t.astype(np.int16)
    step = np.sign(t[1:].astype(np.int64) - t[:-1])
    at = np.where(step != 0, np.arange(n - 1), n - 2)
    ahead = np.minimum.accumulate(at[::-1])[::-1]  # the next position whose symbol changes
    is_s = np.append(step[ahead] > 0, True)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    counts = np.bincount(t)
    ends = np.cumsum(counts)
    starts = ends - counts
    if len(lms) > 1:
        sa = _induce(t, is_s, lms, starts, ends)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = sa[is_lms[sa]]
        length = np.zeros(n, np.int64)
        length[lms[:-1]] = np.diff(lms) + 1
        length[lms[-1]] = 1
        a, b = ordered[:-1], ordered[1:]
        differs = length[a] != length[b]
        live, k = np.flatnonzero(~differs), 0
        while len(live):
            unequal = t[a[live] + k] != t[b[live] + k]
            differs[live[unequal]] = True
            k += 1
            live = live[~unequal]
            live = live[length[a[live]] > k]
        name = np.zeros(n, np.int64)
        name[ordered[1:]] = np.cumsum(differs)
        names = name[lms]
        if names.max() == len(lms) - 1:
            inner = np.argsort(names)
        else:
            inner = suffix_array(names)
        lms = lms[inner]
    return _induce(t, is_s, lms, starts, ends)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of the array, the symbols shared with the suffix before it (0 at the first).

    The prefixes are found by text position: where a suffix and the one before it in the array are preceded by the same
    symbol, the length is one less than at the position before; only the others are compared, symbol by symbol.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    pos = np.arange(n)
    fresh = before < 0
    has = ~fresh & (pos > 0) & (before > 0)
    known = np.zeros(n, bool)
    known[has] = t[pos[has] - 1] == t[before[has] - 1]
    todo = np.flatnonzero(~known & ~fresh)
    plcp = np.zeros(n, np.int64)
    padded = np.append(t.astype(np.int64), -1)
    live, k = todo, 0
    while len(live):
        a, b = live + k, before[live] + k
        equal = padded[a] == padded[b]
        done = live[~equal]
        plcp[done] = k
        live = live[equal]
        k += 1
    base = np.where(known, -1, plcp + pos)
    plcp = np.maximum.accumulate(base) - pos
    plcp[fresh] = 0
    return plcp[sa]
