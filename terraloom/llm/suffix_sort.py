"""Two-stage suffix sorting in numpy, and the windows that occur twice."""

from __future__ import annotations

import numpy as np


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """For each suffix of t whether it is smaller than the next one; the last one is larger than the empty one."""
    n = len(t)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    differ = np.append(t[:-1] != t[1:], True)
    up = np.append(t[:-1] < t[1:], False)
    at = np.flatnonzero(differ)
    return up[at[np.searchsorted(at, np.arange(n))]]


def suffix_array(raw: bytes, depth: int) -> np.ndarray:
    """All suffixes of raw, sorted by their first depth bytes at least.

    Two stages: suffixes smaller than their successors are sorted directly; then one scan over the
    buckets of equal first bytes, in order, places each other suffix when its successor is met.
    Within a bucket the induced suffixes come first. A bucket is taken in waves, since runs of one
    byte induce into their own bucket.
    """
    t = np.frombuffer(raw, np.uint8)
    n = len(t)
    sa = np.empty(n, np.int64)
    if not n:
        return sa
    direct = smaller_than_next(t)
    at = np.flatnonzero(direct)
    keys = [raw[i : i + depth] for i in at.tolist()]
    at = at[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    size = np.bincount(t, minlength=256)
    end = np.cumsum(size)
    start = end - size
    own = np.bincount(t[at], minlength=256)
    first_own = np.cumsum(own) - own
    for c in np.flatnonzero(own).tolist():
        sa[end[c] - own[c] : end[c]] = at[first_own[c] : first_own[c] + own[c]]
    head = start.copy()

    def induce(of: np.ndarray) -> None:
        before = of[of > 0] - 1
        before = before[~direct[before]]
        if len(before):
            c = t[before]
            order = np.argsort(c, kind="stable")
            before, c = before[order], c[order]
            count = np.bincount(c, minlength=256)
            sa[head[c] + np.arange(len(c)) - (np.cumsum(count) - count)[c]] = before
            head[:] += count

    induce(np.array([n]))  # the empty suffix is the smallest
    for c in np.flatnonzero(size).tolist():
        done = start[c]
        while done < head[c]:
            upto = head[c]
            induce(sa[done:upto])
            done = upto
        induce(sa[end[c] - own[c] : end[c]])
    return sa


def common_prefix_at_least(raw: bytes, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Which pairs of suffixes (a[i], b[i]) share their first length bytes; both must have them."""
    t = np.frombuffer(raw + bytes(8), np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(t, 8)[: len(raw) + 1]
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    alike = np.arange(len(a))
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length >= 8 else [])]:
        alike = alike[words[a[alike] + at] == words[b[alike] + at]]
        if not len(alike):
            break
    out = np.zeros(len(a), bool)
    out[alike] = True
    return out


def repeated_windows(fragments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, leader) by position in the fragments joined by a byte each: whether the window of
    length bytes that starts there lies within its fragment and occurs at another place as well, and
    whether it is the first of its kind in suffix order."""
    raw = b"\0".join(fragments)
    sizes = np.array([len(f) for f in fragments])
    begin = np.cumsum(sizes + 1) - sizes - 1
    valid = np.zeros(len(raw) + 1, np.int8)
    fits = sizes >= length
    np.add.at(valid, begin[fits], 1)
    np.add.at(valid, begin[fits] + sizes[fits] - length + 1, -1)
    valid = np.cumsum(valid)[: len(raw)] > 0
    sa = suffix_array(raw, length)
    sa = sa[valid[sa]]
    repeated, leader = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    if len(sa):
        same = common_prefix_at_least(raw, sa[:-1], sa[1:], length)
        repeated[sa[:-1][same]] = True
        repeated[sa[1:][same]] = True
        leader[sa[np.append(True, ~same)]] = True
    return repeated, leader
