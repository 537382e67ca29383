"""Suffix arrays in numpy: refinement by doubling in the manner of Larsson and Sadakane, and Kasai common prefixes.

Both work on all suffixes, or on those alone that have ``depth`` symbols left (``left``: how many each position has, where
several texts stand one after the other). Sorting is by value wherever what is sorted fits 64 bits with the position.
"""

from __future__ import annotations

import numpy as np


def first_ranks(seq: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """A number for each position that orders the first symbols, and how many symbols: up to ``most`` bytes, or 1 integer."""
    if seq.dtype != np.uint8:
        return seq.astype(np.uint64), 1
    padded = np.concatenate([seq, np.zeros(8, np.uint8)]).tobytes()
    return np.ndarray((len(seq),), ">u8", padded, 0, (1,)).astype(np.uint64) >> np.uint64(64 - 8 * most), most


def ordered(*keys: np.ndarray) -> np.ndarray:
    """The order by the keys, ties by place; keys are no negative integers."""
    n = len(keys[0])
    sizes = [int(k.max(initial=0)) + 1 for k in keys]
    room = n
    for s in sizes:
        room *= s
    if room >= 1 << 64:
        return np.lexsort(keys[::-1])
    packed = np.zeros(n, np.uint64)
    for k, s in zip(keys, sizes):
        packed *= np.uint64(s)
        packed += k.astype(np.uint64, copy=False)
    packed *= np.uint64(n)
    packed += np.arange(n, dtype=np.uint64)
    packed.sort()
    return (packed % np.uint64(max(1, n))).astype(np.int32 if n < 1 << 31 else np.int64)


def first_of_run(fresh: np.ndarray) -> np.ndarray:
    """For each place the last place up to it where ``fresh`` is set."""
    place = np.arange(len(fresh), dtype=np.int32 if len(fresh) < 1 << 31 else np.int64)
    return np.maximum.accumulate(np.where(fresh, place, 0).astype(place.dtype))


def changes(*keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = False
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def suffix_array(seq: np.ndarray, depth: int, left: np.ndarray | None = None) -> np.ndarray:
    """Positions in the order of their next ``depth`` symbols, the end of ``seq`` before any symbol; ties by position.

    With ``left``, only positions that have ``depth`` symbols. Each round sorts only groups that are not single yet, by
    the rank of what follows; bytes past the end are zero. A position that has too few symbols for a round keeps the rank of
    the one before, which is as deep as others ask of it.
    """
    n, whole_type = len(seq), np.int32 if len(seq) < (1 << 31) - 1 else np.int64
    # as many symbols to begin with as leave room for the position
    key, h = first_ranks(seq, max(1, min(8, depth, (64 - n.bit_length()) // 8)))
    left = None if left is None else left.astype(whole_type, copy=False)
    who = np.arange(n, dtype=whole_type) if left is None else np.flatnonzero(left >= h).astype(whole_type)
    key = key[who]
    by = ordered(key)
    who, key = who[by], key[by]
    rank = np.zeros(n + 1, whole_type)  # the end has rank 0
    group = first_of_run(changes(key)) + 1
    rank[who] = group
    while h < depth and len(who):
        step = min(h, depth - h)
        if left is not None:
            reach = left[who] >= h + step
            who, group = who[reach], group[reach]
        head = changes(group)
        loose = ~(head & np.append(head[1:], True))  # in groups of two or more
        who, group, head = who[loose], group[loose], head[loose]
        after = rank[np.minimum(who + step, n)]
        by = ordered(np.cumsum(head) - 1, after) if len(who) else np.empty(0, np.int64)
        who, after = who[by], after[by]
        # a group keeps its places: what is sorted differs only inside it
        group = group + first_of_run(changes(group, after)) - first_of_run(head)
        rank[who] = group
        h += step
    whole = np.arange(n) if left is None else np.flatnonzero(left >= depth)
    return whole[ordered(rank[whole])]


def common_prefixes(seq: np.ndarray, sa: np.ndarray, cap: int, lane: int = 64) -> np.ndarray:
    """lcp[r]: symbols that suffixes sa[r - 1] and sa[r] share, up to ``cap``; lcp[0] is 0.

    Kasai: going through the text, the common prefix shrinks by one at most, as long as the suffix after the former
    neighbour still comes first; suffixes that are only ordered up to a depth, or left out of ``sa``, may fail that, and start
    anew. The positions of ``sa`` are cut into lanes of ``lane`` that advance together; bytes are compared eight at a time.
    """
    n, m = len(seq), len(sa)
    lcp = np.zeros(m, np.int64)
    if m < 2:
        return lcp
    rank = np.full(n + 1, m)  # what is not in sa comes after all
    rank[sa] = np.arange(m)
    places = np.flatnonzero(rank[:n] < m)
    at_once, shared = comparer(seq)
    base = np.arange(0, m, lane)
    h = np.zeros(len(base), np.int64)
    before = np.full(len(base), n)  # the position after each lane's former one, and after that one's neighbour
    after = np.full(len(base), n)
    for t in range(min(lane, m)):
        live = np.flatnonzero(base + t < m)
        i = places[base[live] + t]
        r = rank[i]
        h = np.maximum(h - 1, 0)
        h[live[(rank[after[live]] > r) | (before[live] != i)]] = 0
        some = r > 0  # the first suffix of all has nothing before it
        h[live[~some]], after[live[~some]] = 0, n
        live, i, r = live[some], i[some], r[some]
        j = sa[r - 1]
        before[live], after[live] = i + 1, j + 1
        got = h[live]
        open_ = np.flatnonzero(got < cap)
        while len(open_):
            same = shared(i[open_] + got[open_], j[open_] + got[open_])
            got[open_] += same
            open_ = open_[(same == at_once) & (got[open_] < cap)]
        h[live] = lcp[r] = np.minimum(got, cap)
    return lcp


def comparer(seq: np.ndarray):
    """How many symbols are compared at once, and a function from two positions to how many of these agree before the end."""
    n = len(seq)
    if seq.dtype != np.uint8:
        last = np.append(seq, -1)

        def one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return ((np.maximum(a, b) < n) & (last[np.minimum(a, n)] == last[np.minimum(b, n)])).astype(np.int64)

        return 1, one
    words = np.ndarray((n + 1,), "<u8", np.concatenate([seq, np.zeros(8, np.uint8)]).tobytes(), 0, (1,))

    def eight(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        same = np.bitwise_count(~x & (x - np.uint64(1))).astype(np.int64) >> 3  # zero bytes below the first that differs
        return np.minimum(same, np.maximum(n - np.maximum(a, b), 0))

    return 8, eight
