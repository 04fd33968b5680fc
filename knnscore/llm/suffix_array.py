"""Difference-cover suffix sorting in numpy, as far as a bounded prefix asks.

Positions not divisible by three form the cover. Their triples are sorted and named; while names repeat and
cover less than the prefix, the string of names is sorted in the same way. The other suffixes are sorted by
their first symbol and the rank of the next, and both orders are merged.
"""

from __future__ import annotations

import numpy as np


def names_of(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1 of the tuples (first key first), equal ones alike, and how many differ."""
    packed = keys[0]
    for k in keys[1:]:
        wide = int(k.max(initial=0)) + 1
        if (int(packed.max(initial=0)) + 1) * wide >= 1 << 62:
            break
        packed = packed * wide + k
    else:
        keys = (packed,)
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(packed)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return names, int(new.sum())


def suffix_array(symbols: np.ndarray, prefix: int, covered: int = 1) -> np.ndarray:
    """Starts of the suffixes in an order of their first ``prefix`` units; of equal prefixes in any order.

    symbols: positive, bytes or dense names, so that one and a rank fit 62 bits; each stands for ``covered`` units.
    """
    n = len(symbols)
    if n < 4 or covered >= prefix:
        padded = np.r_[symbols, np.zeros(3, np.int64)]
        return np.lexsort((padded[2 : n + 2], padded[1 : n + 1], padded[:n]))
    s = np.r_[symbols.astype(np.int64), np.zeros(3, np.int64)]
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a triple of padding parts the two halves
    cover = np.r_[one, two]
    names, different = names_of(s[cover], s[cover + 1], s[cover + 2])
    if different < len(cover) and 3 * covered < prefix:
        order = suffix_array(names, prefix, 3 * covered)
        names = np.empty(len(cover), np.int64)
        names[order] = np.arange(1, len(order) + 1)
    else:
        order = np.argsort(names)
    rank = np.zeros(n + 3, np.int64)
    rank[cover] = names
    sampled = cover[order]
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    wide = int(rank.max()) + 2
    zero = zero[np.argsort(s[zero] * wide + rank[zero + 1])]
    # how many sampled suffixes are smaller than each of the others, by class of position
    most = int(s.max()) + 1
    pair = lambda at: s[at] * wide + rank[at + 1]
    triple = lambda at: (s[at] * most + s[at + 1]) * wide + rank[at + 2]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    if most * most * wide >= 1 << 62:
        top, _ = names_of(s[:n], s[1 : n + 1])
        top = np.r_[top, 0, 0]
        triple = lambda at: top[at] * wide + rank[at + 2]
    smaller = np.searchsorted(pair(ones), pair(zero)) + np.searchsorted(triple(twos), triple(zero))
    out = np.empty(n, np.int64)
    at = np.arange(len(zero)) + np.maximum.accumulate(smaller) if len(zero) else smaller
    free = np.ones(n, bool)
    free[at] = False
    out[at] = zero
    out[free] = sampled
    return out
