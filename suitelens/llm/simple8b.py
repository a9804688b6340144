"""Simple-8b word-aligned coding of id arrays, vectorised.

A 64-bit word holds a selector in its low 4 bits and, above it, as many ids of equal
width as fit in 60 bits. The last selector is the escape: one id of any width up to
60 bits. Ids are cut into lanes of ``LANE`` ids which are coded independently, so the
encoder steps through all lanes at once and the decoder finds each lane's words by
the offsets stored with a block.
"""

from __future__ import annotations

import numpy as np

#: fixed values: ids per word by selector; an id may be 60 // n bits wide
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = 60 // COUNTS
ESCAPE = len(COUNTS) - 1
LANE = 512
_BITS = np.array([max(1, int(v).bit_length()) for v in range(1 << 16)], np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    if not len(ids) or ids.max() < 1 << 16:
        return _BITS[ids]
    return np.maximum(1, np.searchsorted(np.uint64(1) << np.arange(1, 61, dtype=np.uint64), ids, "right") + 1).astype(np.uint8)


def _best(bits: np.ndarray) -> np.ndarray:
    """For each id the first selector whose count of following ids fits its width."""
    n = len(bits)
    pad = np.concatenate([bits, np.zeros(64, np.uint8)])
    tops = {1: pad}  # tops[m][i]: the widest of m ids from i on
    m = 1
    while m < 32:
        tops[2 * m] = np.maximum(tops[m][:len(tops[m]) - m], tops[m][m:])
        m *= 2
    best = np.full(n, ESCAPE, np.uint8)
    for s in range(len(COUNTS) - 2, -1, -1):
        c = int(COUNTS[s])
        p = 1 << (c.bit_length() - 1)
        top = tops[p][:n] if p == c else np.maximum(tops[p][:n], tops[p][c - p:c - p + n])
        best[top <= WIDTHS[s]] = s
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and for each lane the index of its first word (one more entry: the end)."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    best = _best(_widths(ids))
    at = np.arange(0, n, LANE)
    end = np.minimum(at + LANE, n)
    lane = np.arange(len(at))
    starts, lanes, sels = [], [], []
    while len(at):  # one word of every lane that is not done
        s = best[at]
        starts.append(at)
        lanes.append(lane)
        sels.append(s)
        at = at + COUNTS[s]
        more = at < end
        at, end, lane = at[more], end[more], lane[more]
    start, lane, sel = np.concatenate(starts), np.concatenate(lanes), np.concatenate(sels)
    order = np.argsort(start, kind="stable")  # lanes follow each other, so this is by lane, then place
    start, lane, sel = start[order], lane[order], sel[order]
    words = sel.astype(np.uint64)
    padded = np.concatenate([ids.astype(np.uint64), np.zeros(64, np.uint64)])
    stop = np.minimum((start // LANE + 1) * LANE, n)
    for s in np.unique(sel).tolist():
        rows = np.flatnonzero(sel == s)
        first, w = start[rows], int(WIDTHS[s])
        value = np.zeros(len(rows), np.uint64)
        for j in range(int(COUNTS[s])):
            one = padded[first + j]
            if j:
                one = np.where(first + j < stop[rows], one, np.uint64(0))
            value |= one << np.uint64(4 + j * w)
        words[rows] |= value
    return words, np.searchsorted(start, np.arange(0, n + LANE, LANE)[:-(-n // LANE) + 1], "left").astype(np.uint32)


def decode(words: np.ndarray, lanes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block from its words and lane offsets."""
    sel = (words & np.uint64(15)).astype(np.int64)
    count = COUNTS[sel]
    before = np.cumsum(count) - count
    first = np.repeat(lanes[:-1].astype(np.int64), np.diff(lanes.astype(np.int64)))  # first word of each word's lane
    lane = np.repeat(np.arange(len(lanes) - 1), np.diff(lanes.astype(np.int64)))
    place = before - before[first] + lane * LANE
    stop = np.minimum((lane + 1) * LANE, n)
    out = np.zeros(n + 64, np.uint64)
    for s in np.unique(sel).tolist():
        rows = np.flatnonzero(sel == s)
        w = int(WIDTHS[s])
        mask = np.uint64((1 << w) - 1)
        for j in range(int(COUNTS[s])):
            to = place[rows] + j
            ok = to < stop[rows]
            out[to[ok]] = (words[rows[ok]] >> np.uint64(4 + j * w)) & mask
    return out[:n]
