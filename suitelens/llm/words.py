"""Vectorised word splitting and 64-bit names for words and windows.

A word's name is a sum over its symbols of random-looking numbers that a key, the symbol
and its place in the word give, finished by a bit mixer. Equal words always get
equal names; different words get equal names with a chance of about 2**-64 per pair, for any
words that were written without knowing the key (``fresh_key``).

A window's name is a polynomial over its words' names modulo 2**64. Windows of up to
``width`` names that differ collide with a chance of at most about 2**(v - 64), v being
13 for 20 names and 26 for 64: the names, not the windows' pattern, are what is random.
"""

from __future__ import annotations

import secrets

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SLICE = 1 << 18
_powers: dict[str, np.ndarray] = {}
_PLACES = 64  # places in a word whose numbers are kept in a table, for symbols below 256
_tables: dict[int, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit name: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of the spans ``data[starts:ends]`` (any unsigned data; starts in order)."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):  # slice by slice, in the processor's cache
        a = int(starts[k])
        z = max(k + 1, int(np.searchsorted(starts, a + _SLICE, "left")))
        begin, end = starts[k:z] - a, ends[k:z] - a
        part = data[a:a + int(end.max())]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(part)), out=sums[1:])
        out[k:z] = mix((sums[end] - sums[begin]) * _power("down", _INVERSE, len(part) + 1)[begin])
        k = z
    return out


def fresh_key() -> int:
    """A random key for ``word_names``; one job uses one key on all machines."""
    return secrets.randbits(63)


def _numbers(key: int, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    spread = mix((place.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE) + np.uint64(key))
    return mix(spread ^ (symbol.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(key >> 7)))


def _table(key: int) -> np.ndarray:
    if key not in _tables:
        if len(_tables) > 8:
            _tables.clear()
        _tables[key] = _numbers(key, np.repeat(np.arange(_PLACES), 256), np.tile(np.arange(256), _PLACES))
    return _tables[key]


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit names of the words ``data[starts:ends]`` (bytes or code points; words in order,
    not overlapping)."""
    table = _table(key)
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):  # slice by slice, in the processor's cache
        a = int(starts[k])
        z = max(k + 1, int(np.searchsorted(starts, a + _SLICE, "left")))
        begin, end = starts[k:z] - a, ends[k:z] - a
        part = data[a:a + int(end[-1])]
        place = np.arange(len(part), dtype=np.int32) - np.repeat(begin.astype(np.int32), np.diff(np.append(begin, len(part))))
        symbol = part.astype(np.int32)
        numbers = table[((place & (_PLACES - 1)) << 8) | (symbol & 255)]
        rest = np.flatnonzero((place >= _PLACES) | (symbol > 255))
        if len(rest):
            numbers[rest] = _numbers(key, place[rest], symbol[rest])
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(numbers, out=sums[1:])
        out[k:z] = mix(sums[end] - sums[begin] + (end - begin).astype(np.uint64) * np.uint64(_BASE))
        k = z
    return out


def byte_table(pattern_bytes) -> np.ndarray:
    """Boolean table of 256 entries: which bytes belong to words."""
    out = np.zeros(256, bool)
    out[list(pattern_bytes)] = True
    return out


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = byte_table(set(range(256)) - {0x20, *range(0x09, 0x0E)})
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = byte_table({*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)})
#: A-Z to a-z, other bytes unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def split_words(data: np.ndarray, doc_begin: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``; no word crosses a document's begin."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)  # a document begins here
    edge[doc_begin] = True
    edge[len(data)] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_counts(starts: np.ndarray, doc_begin: np.ndarray, n: int) -> np.ndarray:
    """Index of each document's first word, and the number of words at the end."""
    return np.concatenate([np.searchsorted(starts, doc_begin, "left"), [len(starts)]])


def window_names(names: np.ndarray, width: int) -> np.ndarray:
    """Names of all windows of ``width`` consecutive symbols, by doubling: the name of
    2m symbols joins the names of its two halves. ``len(names) - width + 1`` entries."""
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor, done, have, part = _BASE, 0, None, names
    power, length = factor, 1  # part names `length` symbols; power = factor ** length
    rest = width
    while rest:
        if rest & 1:
            if have is None:
                have, done = part, length
            else:
                have = have[:len(names) - done - length + 1] * np.uint64(power) + part[done:done + len(names) - done - length + 1]
                done += length
        rest >>= 1
        if rest:
            part = part[:-length] * np.uint64(power) + part[length:]
            power = power * power & (1 << 64) - 1
            length *= 2
    return have[:n]
