"""Benchmark decontamination with suffix arrays over the training text.

Each task sorts the word suffixes of its documents (a shard's suffix array) and
binary-searches every suffix of the benchmark in it. What is found are the longest
verbatim matches and their places; the words inside them are counted, and documents
with any are marked.

A suffix array entry is a word position, compared by the names of its next words up
to the window's width. Positions whose first words (three, or the whole window when
it is shorter) begin no benchmark window can match none and are left out before the
sort. Word names have 64 bits; every match is then compared word by word.

The documents are only scanned: no shuffle, and no group of any kind. The benchmark
goes to the executors in blocks of a bounded size, one at a time: what a block finds is stored with the documents,
and the next block's pass reads that. So driver and workers hold one block at once; more blocks mean more passes.

Defined cases: a null or empty text has no words; an item without words never occurs;
an item of fewer words than a window is one window; items with a null id mark the
words they hit but are not listed; repeated items and documents are judged each for
itself; an empty table gives an empty result, an empty benchmark no hits; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitelens.llm.common import TextChunk, prepare, stored, text_chunks
from suitelens.llm.words import ALNUM, LOWER, mix, span_names, split_words

WINDOW = 10
#: benchmark text that goes to the executors at once
BLOCK_BYTES = 1 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SEED = 3  # words that must begin a benchmark window


def _seeds(names: np.ndarray, width: int) -> np.ndarray:
    """Name of the first ``width`` of each window's words (``names``: n x at least width)."""
    out = np.zeros(len(names), np.uint64)
    for k in range(width):
        out = mix(out + names[:, k])
    return out


class Block:
    """The windows of some benchmark items, as lists of words and as names."""

    def __init__(self, items: list[tuple], width: int = WINDOW):
        self.width = width
        self.items = [(i, _WORD.findall((t or "").encode().translate(bytes(LOWER)))) for i, t in items]
        words = sorted({w for _, ws in self.items for w in ws})
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        name = dict(zip(words, span_names(data, ends - [len(w) for w in words], ends).tolist(), strict=True)) if words else {}
        seen: dict[tuple, int] = {}
        self.windows: list[tuple] = []  # distinct windows
        self.of: list[list[tuple[int, int]]] = []  # the items, and places in them, of each
        for k, (_, ws) in enumerate(self.items):
            for at in range(max(1, len(ws) - width + 1) if ws else 0):
                w = tuple(ws[at:at + width])
                if w not in seen:
                    seen[w] = len(self.windows)
                    self.windows.append(w)
                    self.of.append([])
                self.of[seen[w]].append((k, at))
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        names = np.zeros((len(self.windows), width), np.uint64)
        for r, w in enumerate(self.windows):
            names[r, :len(w)] = [name[x] for x in w]
        self.seeds = {}
        for n in {min(_SEED, len(w)) for w in self.windows}:
            rows = np.minimum(self.lengths, _SEED) == n
            self.seeds[n] = np.unique(_seeds(names[rows], n))
        self.low = _keys(names)
        high = names.copy()
        for r, n in enumerate(self.lengths):
            high[r, n:] = np.iinfo(np.uint64).max
        self.high = _keys(high)


def _keys(names: np.ndarray) -> np.ndarray:
    """Rows of names as byte strings that sort as the rows do."""
    return np.ascontiguousarray(names.astype(">u8")).view(f"S{8 * names.shape[1]}").ravel() if len(names) else np.zeros(0, f"S{8 * names.shape[1]}")


def _matches(names: np.ndarray, doc_last: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(word position, window) of every occurrence: sort the suffixes, search each window.
    ``doc_last``: for each word the index after its document's last word."""
    n, width = len(names), block.width
    padded = np.concatenate([names, np.zeros(width, np.uint64)])
    keep = np.zeros(n, bool)
    at = np.arange(n)
    for k, seeds in block.seeds.items():
        rows = at[at + k <= doc_last]
        if len(rows):
            found = _seeds(np.stack([padded[rows + j] for j in range(k)], 1), k)
            pos = np.minimum(np.searchsorted(seeds, found), len(seeds) - 1)
            keep[rows[seeds[pos] == found]] = True
    at = np.flatnonzero(keep)
    if not len(at):
        return at, at
    grid = np.stack([np.where(at + j < doc_last[at], padded[at + j], np.uint64(0)) for j in range(width)], 1)
    keys = _keys(grid)
    order = np.argsort(keys, kind="stable")  # the suffix array
    keys = keys[order]
    low, high = np.searchsorted(keys, block.low, "left"), np.searchsorted(keys, block.high, "right")
    count = high - low
    window = np.repeat(np.arange(len(low)), count)
    place = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return at[order[place]], window


_MATCH = pa.struct([("item", pa.int64()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])
_ADDED = pa.schema([("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("matches", pa.list_(_MATCH)),
                    ("items", pa.list_(pa.string()))])


def _found(chunk: TextChunk, block: Block) -> tuple[np.ndarray, list[list[int]], list[list[dict]], list[list[str]]]:
    """For each document: its words, the hit ones, the longest matches, the items' ids."""
    low = LOWER[chunk.data]
    starts, ends = split_words(low, chunk.begin, ALNUM)
    first, last = np.searchsorted(starts, chunk.begin, "left"), np.searchsorted(starts, chunk.end, "left")
    hits, found, ids = ([[] for _ in range(len(chunk))] for _ in range(3))
    if len(starts) and block.windows:
        at, window = _matches(span_names(low, starts, ends), np.repeat(last, last - first), block)
        by_doc: dict[int, list] = {}
        for d, p, w in zip(np.searchsorted(last, at, "right").tolist(), at.tolist(), window.tolist(), strict=True):
            if all(low[starts[p + j]:ends[p + j]].tobytes() == x for j, x in enumerate(block.windows[w])):
                by_doc.setdefault(d, []).append((p - int(first[d]), w))
        for d, pairs in by_doc.items():
            hits[d] = sorted({p + j for p, w in pairs for j in range(int(block.lengths[w]))})
            found[d] = _longest(pairs, block)
            ids[d] = sorted({block.items[m["item"]][0] for m in found[d]} - {None})
    return last - first, hits, found, ids


def _longest(pairs: list[tuple[int, int]], block: Block) -> list[dict]:
    """Join windows that follow each other in the item and in the document."""
    runs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for p, w in sorted(set(pairs)):
        for item, at in block.of[w]:
            run = runs.setdefault((item, p - at), [])
            if run and run[-1][1] + 1 == at:
                run[-1] = (run[-1][0], at)
            else:
                run.append((at, at))
    return [{"item": item, "item_word": a, "doc_word": a + shift, "n_words": b - a + min(block.width, len(block.items[item][1]))}
            for (item, shift), run in sorted(runs.items()) for a, b in run]


def benchmark_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items in blocks of at most ``block_bytes`` of text (or one item)."""
    block, held = [], 0
    for r in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        n = len((r["t"] or "").encode())
        if block and held + n > block_bytes:
            yield block
            block, held = [], 0
        block.append((r["i"], r["t"]))
        held += n
    yield block


def find_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """For every document ``doc_id, n_words, hits`` (positions of hit words), ``matches``
    (of each longest match ``item``, the item's row number, ``item_word``, ``doc_word``,
    ``n_words``) and ``items`` (ids, as strings, of the items that occur, sorted)."""
    spark = docs.sparkSession
    prepare(spark)
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    added = "n_words long, hits array<long>, matches array<struct<item: long, item_word: long, doc_word: long, n_words: long>>, items array<string>"
    base = 0
    for k, items in enumerate(benchmark_blocks(benchmark, item_id, item_text)):
        block = spark.sparkContext.broadcast(Block(items, window))

        def run(batches, block=block, base=base, later=k > 0):
            for batch in batches:
                for chunk in text_chunks(iter([batch])):
                    n, hits, found, ids = _found(chunk, block.value)
                    for ms in found:
                        for m in ms:
                            m["item"] += base
                    if later:  # add to what the blocks before have found
                        hits = [sorted({*a, *b}) for a, b in zip(chunk.column("hits").to_pylist(), hits, strict=True)]
                        found = [a + b for a, b in zip(chunk.column("matches").to_pylist(), found, strict=True)]
                        ids = [sorted({*a, *b}) for a, b in zip(chunk.column("items").to_pylist(), ids, strict=True)]
                    arrays = [pa.array(x, f.type) for x, f in zip((n, hits, found, ids), _ADDED, strict=True)]
                    yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("text"), *arrays],
                                                     names=["doc_id", "text", *_ADDED.names])

        if k:
            out = stored(out, "block-hits")
        out = out.mapInArrow(run, f"doc_id long, text string, {added}")
        base += len(items)
    return out.drop("text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs``, with all its columns, without the documents that hold any benchmark window."""
    spark = docs.sparkSession
    prepare(spark)
    out = docs
    for k, items in enumerate(benchmark_blocks(benchmark, item_id, item_text)):
        if k:
            out = stored(out, "block-kept")
        block = spark.sparkContext.broadcast(Block(items, window))

        def run(batches, block=block):
            for batch in batches:
                for chunk in text_chunks(iter([batch]), text):
                    hits = _found(chunk, block.value)[1]
                    yield chunk.rows.filter(pa.array([not h for h in hits], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out
