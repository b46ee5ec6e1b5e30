"""Repeated strings of a fixed length by bounded interval expansion on a Burrows-Wheeler transform.

The suffixes of a block are ordered by their first 256 bytes (prefix doubling); that is as much order as backward extension
of strings of up to 255 bytes can see. From the transform alone, intervals of equal prefixes are then extended backward
breadth-first: the intervals of cw for every byte c in front of w give the boundaries whose common prefix is |w|, in
increasing order of |w|, until the wanted length. Boundaries that were never set join suffixes with at least that much in common.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K

SEPARATOR = 0xFF  # never a byte of UTF-8
_HEAD = 8


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes ordered by their first `depth` bytes or more, common prefix with the one before up to 8 bytes)."""
    n = len(text)
    wide = np.zeros(n + _HEAD, np.uint64)
    for j in range(_HEAD):
        wide[: n - j] |= text[j:].astype(np.uint64) << np.uint64(8 * (_HEAD - 1 - j))
    wide = wide[:n]
    order = np.argsort(wide).astype(np.int32)
    key = wide[order]
    differ = np.empty(n, np.uint64)
    differ[0] = np.uint64(1 << 63)
    differ[1:] = key[1:] ^ key[:-1]
    head = np.full(n, _HEAD, np.uint8)
    for j in range(_HEAD - 1, -1, -1):
        head[differ >> np.uint64(8 * (_HEAD - 1 - j)) != 0] = j
    del wide, key
    first = np.flatnonzero(differ)
    group = np.zeros(n, np.int32)
    group[first] = 1
    start_of = first[np.cumsum(group) - 1].astype(np.int32)  # rank: where the suffix's group begins
    rank = np.zeros(n + depth, np.int32)
    rank[order] = start_of + 1
    step = _HEAD
    sizes = np.diff(np.append(first, n))
    active = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while step < depth and len(active):
        at = order[active]
        key = (rank[at].astype(np.int64) << 32) | rank[at + step]
        move = np.argsort(key, kind="stable")
        at, key = at[move], key[move]
        order[active] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, len(at)))
        fresh = np.repeat(active[begin], sizes)
        rank[at] = fresh + 1
        active = active[np.repeat(sizes > 1, sizes)]
        step *= 2
    return order, head


def joined(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, for every place whether its suffix shares `length` bytes with the one before)."""
    n = len(text)
    order, head = suffix_order(text, max(length + 1, 2 * _HEAD))
    before = text[order - 1]
    before[order == 0] = SEPARATOR
    by_byte = np.argsort(before, kind="stable").astype(np.int32)
    lf = np.empty(n, np.int32)
    lf[by_byte] = np.arange(n, dtype=np.int32)
    later, sooner = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    same = before[by_byte[1:]] == before[by_byte[:-1]]
    later[by_byte[:-1][same]] = by_byte[1:][same]
    sooner[by_byte[1:][same]] = by_byte[:-1][same]
    open_ = before != SEPARATOR
    unset = np.append(head >= _HEAD, False)  # boundary i lies before place i
    cuts = np.append(np.flatnonzero(~unset[:n]), n)
    right = np.flatnonzero(np.append(head, 0)[cuts[1:]] == _HEAD - 1)
    lo, hi = cuts[:-1][right], cuts[1:][right]
    for _ in range(_HEAD, length):
        if not len(lo):
            break
        owner, at = K.runs(hi - lo)
        place = lo[owner] + at
        use = open_[place]
        place, owner = place[use], owner[use]
        last = place[later[place] >= hi[owner]]
        first = place[sooner[place] < lo[owner]]
        ends, begins = np.sort(lf[last]) + 1, np.sort(lf[first])
        new = unset[ends]
        lo, hi = begins[new].astype(np.int64), ends[new].astype(np.int64)
        unset[hi] = False
    return order, unset[:n]


def repeated_starts(segments: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For every segment the starts whose `length`-byte string has another start, here or in a segment of weight over 1."""
    sizes = np.array([len(s) for s in segments], np.int64)
    text = np.frombuffer(bytes([SEPARATOR]).join(segments) + bytes([SEPARATOR]), np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    order, shares = joined(text, length)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    valid = np.arange(len(text)) - begin[owner] <= (sizes - length)[owner]
    run = np.cumsum(~shares) - 1
    weight = np.bincount(run, weights[owner[order]] * valid[order])
    hit = np.zeros(len(text), bool)
    hit[order] = (weight > 1)[run]
    hit &= valid
    places = np.flatnonzero(hit)
    cut = np.searchsorted(places, begin)
    return [places[a:b] - s for a, b, s in zip(cut, np.append(cut[1:], len(places)), begin, strict=True)]
