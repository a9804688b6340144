"""Substring dedup with prefix-partitioned suffix trees over words.

Removes every word covered by a window of ``width`` words whose sequence also starts
earlier.

* Across tasks, suffixes are dealt by the ``gram`` words at their anchor (see ``repeats``; it is the
  same for equal windows, so all suffixes that can share a deep node meet in one bucket).
  Where an anchor has too many contexts for a bucket, the prefix is lengthened to all words of the
  window: its windows are dealt by the name of those and compared by it.
* Within a bucket, prefixes of varying length split the suffixes into groups of at most
  ``GROUP_SUFFIXES``: a prefix is lengthened while its group is larger. Suffixes that are alone
  with their prefix leave, as no deep node is above them.
* The leaves of a group's tree are its suffixes in sorted order, each up to the end of its context;
  common lengths of neighbours give its nodes. A topmost node of at least ``width`` words is a
  repeat: its leaves are the places, and no longer string has the same ones, unless it goes
  on beyond the context.

Defined cases: a null or empty text has no words; a text of fewer than ``width`` words
keeps all; equal windows at the same id and place (repeated rows) do not remove each
other; a null id is smaller than all; an empty table gives an empty result; other columns
are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from suitelens.llm.repeats import Symbols, remove_repeats
from suitelens.llm.words import fresh_key

WIDTH, GRAM = 20, 8
#: suffixes in one tree at most, unless all of them share ``width`` words
GROUP_SUFFIXES = 1 << 15


def context_stops(starts: np.ndarray, width: int) -> np.ndarray:
    """Where the suffix at each of ``starts`` ends: behind the last window of its run of neighbouring
    starts, that is of its context, which has fewer than ``2 * width`` symbols."""
    last = np.flatnonzero(np.append(starts[1:] != starts[:-1] + 1, True)) if len(starts) else starts
    return np.minimum(np.repeat(starts[last] + width, np.diff(np.append(-1, last))), starts + 2 * width)


def prefix_groups(rank: np.ndarray, starts: np.ndarray, width: int, limit: int = GROUP_SUFFIXES) -> Iterator[np.ndarray]:
    """Indices into ``starts`` by group: suffixes of one or more whole prefixes, at most ``limit`` of them
    together, but for a prefix of ``width`` symbols. ``rank``: the symbols, numbered from 1."""
    open_, path, used = np.arange(len(starts)), np.zeros(len(starts), np.int64), 0
    while len(open_):
        _, path, n = np.unique(path, return_inverse=True, return_counts=True)
        many = n > (limit if used < width else 0)
        done = np.flatnonzero((n[path] > 1) & ~many[path]) if used < width else np.arange(len(open_))
        if len(done):  # whole prefixes, side by side up to the limit
            done = done[np.argsort(path[done], kind="stable")]
            first = np.flatnonzero(np.append(True, path[done][1:] != path[done][:-1]))
            at = load = 0
            for begin, size in zip(first.tolist(), np.diff(np.append(first, len(done))).tolist(), strict=True):
                if load and load + size > limit:
                    yield open_[done[at:begin]]
                    at, load = begin, 0
                load += size
            yield open_[done[at:]]
        if used == width:
            return
        more = many[path]
        open_, path = open_[more], path[more]
        path = path * (int(rank.max()) + 1 if len(rank) else 1) + rank[starts[open_] + used]
        used += 1


def sorted_leaves(rank: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes ``starts`` to ``stops``, shorter ones before what goes on from them, and
    the common length of each with the one before it (0 for the first)."""
    longest = int((stops - starts).max()) if len(starts) else 0
    at = starts[:, None] + np.arange(longest)
    paths = np.where(at < stops[:, None], rank[np.minimum(at, len(rank) - 1)], 0).astype(">u4")
    order = np.argsort(paths.view(f"S{4 * longest}").ravel()) if longest else np.arange(len(starts))
    paths = paths[order]
    differ = paths[1:] != paths[:-1]
    common = np.where(differ.any(1), differ.argmax(1), longest)
    length = (stops - starts)[order]
    return order, np.append(0, np.minimum(common, np.minimum(length[1:], length[:-1]))) if len(starts) else length


def deep_nodes(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Topmost nodes of at least ``depth`` symbols: first leaf, number of leaves (two or more), symbols.
    ``common``: of neighbouring leaves, from ``sorted_leaves``."""
    first = np.flatnonzero(common < depth)
    if not len(first):
        return first, first, first
    n = np.diff(np.append(first, len(common)))
    inner = common.copy()
    inner[first] = np.iinfo(np.int64).max
    symbols = np.minimum.reduceat(inner, first)
    many = n > 1
    return first[many], n[many], symbols[many]


def repeat_numbers(names: np.ndarray, starts: np.ndarray, width: int, limit: int = GROUP_SUFFIXES) -> np.ndarray:
    """A number for the window at each of ``starts``: the deep node above its leaf, or one of its own."""
    out = np.arange(len(starts))
    if not len(starts):
        return out
    rank = np.unique(names, return_inverse=True)[1] + 1
    stops = context_stops(starts, width)
    for group in prefix_groups(rank, starts, width, limit):
        order, common = sorted_leaves(rank, starts[group], stops[group])
        first, n, _ = deep_nodes(common, width)
        leaves = group[order]
        node = np.repeat(leaves[first], n)
        out[leaves[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]] = node
    return out


def dedup_words(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (without ``text``) with ``n_symbols, n_removed, spans, kept``; see ``repeats.remove_repeats``."""
    def compare(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return repeat_numbers(names, starts, width)
    return remove_repeats(docs, Symbols(words=True, width=width, gram=gram, strict=False, key=fresh_key()), compare, doc_id, text)
