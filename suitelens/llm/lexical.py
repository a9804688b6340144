"""Ranked lexical search with a document FP-tree and branch-and-bound.

1. Items (queries) come in blocks of bounded size. The terms of a block are its vocabulary; documents are
   read once per block, and each keeps only the terms of that vocabulary (``restricted``): counts, numbers of terms.
2. Document frequencies, the number of documents and of terms are summed up; from them come the weight of each
   term and the length measure ``m`` of each document.
3. A task puts restricted vectors into FP-trees: a document is the path of its terms, frequent ones first, so that
   documents share the upper part of their paths. A node stands for the terms that its documents go on to share; it holds the
   maxima of tf of all terms on its path, the largest tf further down, and the least ``m`` below it.
4. Items go down a tree depth first. What an item can get below a node is at most what the maxima on the path and the
   least ``m`` give, and for its terms that come later in the order, the largest tf below. An item leaves a subtree that
   cannot reach its ``k``-th best so far; a node is visited by those items that are left.
5. Each task reports its best per item; the best of salted groups of tasks, and then of all, are the result.

A document's score is the sum of ``w * ((10**9 * tf) div (1000 * tf + 8 * m))`` over the item's terms, once each.

Defined cases: a null text has no terms; documents without any term do not count and have no score; rows of one
item id, null included, are one item with all their terms; an item without terms has no result; rows with one document id
are documents of their own; a null document id is smaller than all; empty tables give an empty result; extra
columns are not looked at.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from suitelens.llm.common import prepare, stored, text_chunks
from suitelens.llm.words import ALNUM, LOWER, fresh_key, split_words, word_names

#: items in one block, and terms of all of them (an item with more is a block of its own)
BLOCK_ITEMS, BLOCK_TERMS = 256, 1 << 14
#: documents of one tree, and terms of all of them
TREE_DOCUMENTS, TREE_TERMS = 4096, 1 << 19
#: groups of tasks whose results are merged first
SALTS = 64
_LEAST = -(1 << 63)


def terms_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all terms, and the index of each one's document."""
    low = LOWER[data]
    starts, ends = split_words(low, begin, ALNUM)
    n = np.searchsorted(starts, end, "left") - np.searchsorted(starts, begin, "left")
    return word_names(low, starts, ends, key), np.repeat(np.arange(len(begin)), n)


# --- items -------------------------------------------------------------------------------

def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item, term``: the distinct terms of each item, A-Z lower-cased."""
    low = F.translate(F.col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return items.select(F.col(item_id).alias("item"), F.explode(F.regexp_extract_all(low, F.lit(pattern), F.lit(0))).alias("term")).distinct()


def blocks_of(terms: DataFrame) -> DataFrame:
    """``item, term, block``: items in blocks of at most ``BLOCK_ITEMS`` items and about ``BLOCK_TERMS`` terms."""
    size = terms.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    # items of like size make blocks: class 0 has items of up to BLOCK_TERMS / BLOCK_ITEMS terms, each class twice as many
    least = BLOCK_TERMS // BLOCK_ITEMS
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / least))).cast("int")
    room = F.greatest(F.lit(1), F.lit(BLOCK_ITEMS) / F.pow(F.lit(2), "level")).cast("long")
    leveled = size.withColumn("level", level)
    count = leveled.groupBy("level").agg(F.count(F.lit(1)).alias("items"))
    # a hash deals the items of a class to blocks half full on average
    dealt = leveled.join(F.broadcast(count), "level").withColumn("blocks", F.ceil(2 * F.col("items") / room)) \
        .withColumn("block", F.concat_ws("-", "level", F.when(F.col("items") <= room, F.lit(0))
                                         .otherwise(F.pmod(F.xxhash64("item"), F.col("blocks")))))
    return terms.join(dealt.select(F.col("item").alias("_item"), "block"), F.col("item").eqNullSafe(F.col("_item"))).select("item", "term", "block")


class Block:
    """The items of a block: vocabulary, and which item has which term."""

    def __init__(self, rows: list[tuple[object, str]], key: int):
        self.key = key
        self.items = sorted({i for i, _ in rows}, key=lambda i: (i is not None, i))
        number = {i: k for k, i in enumerate(self.items)}
        words = sorted({t for _, t in rows})
        raw = [w.encode() for w in words]
        end = np.cumsum([len(r) for r in raw])
        names = word_names(np.frombuffer(b"".join(raw), np.uint8), end - [len(r) for r in raw], end, key)
        order = np.argsort(names)
        self.names = names[order]
        place = {words[k]: p for p, k in enumerate(order.tolist())}
        self.has = np.zeros((len(words), len(self.items)), bool)
        for i, t in rows:
            self.has[place[t], number[i]] = True

    def find(self, names: np.ndarray) -> np.ndarray:
        """Number of each name in the vocabulary; -1 if it has none."""
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, at, -1)


# --- restricted vectors ------------------------------------------------------------------

_VECTORS = "n_docs long, n_terms long, held int, body binary"


def restricted(docs: DataFrame, block: Block, doc_id: str, text: str) -> DataFrame:
    """Stored vectors: of each chunk the number of documents with terms and of terms, and, of those documents with terms of
    the block, ids, numbers of terms, vocabulary numbers and tf."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for chunk in text_chunks(parts):
            names, doc = terms_of(chunk.data, chunk.begin, chunk.end, block.key)
            n = np.bincount(doc, minlength=len(chunk))
            found = block.find(names)
            hit = np.flatnonzero(found >= 0)
            pair, tf = np.unique(doc[hit] * len(block.names) + found[hit], return_counts=True)
            who, term = pair // len(block.names), pair % len(block.names)
            held, count = np.unique(who, return_counts=True)
            body = b"".join(x.astype(t).view(np.uint8).reshape(-1, np.dtype(t).itemsize).T.tobytes() for x, t in (
                (chunk.longs("doc_id")[held], "<i8"), (n[held], "<i8"), (count, "<u4"), (term, "<u4"), (tf, "<u4")))
            row = int((n > 0).sum()), int(n.sum()), len(held), struct.pack("<Q", len(body)) + zstandard.ZstdCompressor(level=3).compress(body)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)],
                                             names=[f.split()[0] for f in _VECTORS.split(", ")])

    return stored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _VECTORS),
                  "restricted", "uncompressed")


def _vectors(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids, numbers of terms, counts of entries, terms and tf of one chunk after the other."""
    import zstandard

    for batch in parts:
        for held, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            body = body.as_py()
            raw = zstandard.ZstdDecompressor().decompress(body[8:], max_output_size=struct.unpack_from("<Q", body)[0] or 1)
            m, at, out = (len(raw) - 20 * held) // 8, 0, []
            for n, t in ((held, "<i8"), (held, "<i8"), (held, "<u4"), (m, "<u4"), (m, "<u4")):
                w = np.dtype(t).itemsize
                planes = np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n)
                out.append(np.ascontiguousarray(planes.T).view(t).ravel().astype(np.int64))
                at += n * w
            yield tuple(out)


def document_frequencies(vectors: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each term of the vocabulary is."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for *_, term, _ in _vectors(parts):
            df += np.bincount(term, minlength=terms)
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(df[k])], names=["term", "df"])

    rows = vectors.select("held", "body").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(terms, np.int64)  # one number for each term of a block
    for r in rows:
        out[r["term"]] = r["df"]
    return out


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def part_of_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one term's occurrences are worth, before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# --- the tree ----------------------------------------------------------------------------

class Tree:
    """An FP-tree of documents. ``rank``: the terms' places in the order of frequency."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, paths: list[np.ndarray], tfs: list[np.ndarray], k: int):
        keys = [p.astype(">u4").tobytes() for p in paths]
        order = sorted(range(len(paths)), key=lambda d: (keys[d], tfs[d].tobytes(), m[d], ids[d]))
        # documents with the same vector and m tie in every item: the least ids stand for them
        self.paths, self.tfs, self.m, self.ids = [], [], [], []
        last = None
        for d in order:
            same = keys[d], tfs[d].tobytes(), int(m[d])
            if same == last:
                if len(self.ids[-1]) < k:
                    self.ids[-1].append(int(ids[d]))
                continue
            last = same
            self.paths.append(paths[d])
            self.tfs.append(tfs[d])
            self.m.append(int(m[d]))
            self.ids.append([int(ids[d])])
        n = len(self.paths)
        self.shared = [0] * n  # length of the path that a leaf shares with the one before it
        for d in range(1, n):
            a, b = self.paths[d - 1], self.paths[d]
            length = min(len(a), len(b))
            differ = np.flatnonzero(a[:length] != b[:length])
            self.shared[d] = int(differ[0]) if len(differ) else length
        self._nodes()

    def _nodes(self) -> None:
        """Inner nodes: depth (length of the path), children (inner nodes, or ``~leaf``), maxima."""
        self.depth, self.children = [], []
        stack: list[int] = []  # open nodes, from the root down

        def node(depth: int, first: list[int]) -> int:
            self.depth.append(depth)
            self.children.append(first)
            return len(self.depth) - 1

        if not self.paths:
            return
        stack = [node(0, [])]
        before = ~0
        for d in range(1, len(self.paths)):
            shared = self.shared[d]
            while self.depth[stack[-1]] > shared:
                done = stack.pop()
                self.children[done].append(before)
                before = done
            if self.depth[stack[-1]] < shared:
                stack.append(node(shared, []))
            self.children[stack[-1]].append(before)
            before = ~d
        while stack:
            done = stack.pop()
            self.children[done].append(before)
            before = done
        self.root = before
        # from the leaves up; children have greater numbers than their parents or are leaves
        n = len(self.depth)
        self.path_of, self.tf_max, self.tf_below, self.m_least = [0] * n, [None] * n, [0] * n, [0] * n
        for v in self._upward():
            depth = self.depth[v]
            maxima, below, least = [], 0, None
            for c in self.children[v]:
                tf = self.tfs[~c] if c < 0 else self.tf_max[c]
                maxima.append(tf[:depth])
                rest = int(tf[depth:].max()) if len(tf) > depth else 0
                below = max(below, rest, 0 if c < 0 else self.tf_below[c])
                m = self.m[~c] if c < 0 else self.m_least[c]
                least = m if least is None else min(least, m)
            c = self.children[v][0]
            self.path_of[v] = ~c if c < 0 else self.path_of[c]
            self.tf_max[v] = np.max(maxima, axis=0) if depth else np.zeros(0, np.int64)
            self.tf_below[v], self.m_least[v] = below, least

    def _upward(self) -> list[int]:
        out, open_ = [], [self.root]
        while open_:
            v = open_.pop()
            out.append(v)
            open_ += [c for c in self.children[v] if c >= 0]
        return out[::-1]


class Best:
    """The ``k`` best documents of each item so far: by score, then by id."""

    def __init__(self, items: int, k: int):
        self.k, self.held = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # a score below it is of no use

    def add(self, items: np.ndarray, scores: np.ndarray, ids: list[int]) -> None:
        for i, s in zip(items.tolist(), scores.tolist(), strict=True):
            held = self.held[i]
            held += [(-s, d) for d in ids]
            if len(held) > 4 * self.k or len(held) >= self.k and s > self.least[i]:
                held.sort()
                del held[self.k:]
                if len(held) == self.k:
                    self.least[i] = -held[-1][0]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for i, held in enumerate(self.held):
            for s, d in sorted(held)[:self.k]:
                yield i, -s, d


def search(tree: Tree, weights: np.ndarray, later: np.ndarray, best: Best) -> int:
    """Take all items down the tree; ``weights``: term ranks x items; ``later``: the sum of the weights of an item's
    terms from a rank on. Returns the number of nodes and leaves visited."""
    visited = 0
    if not tree.paths:
        return visited
    stack = [(tree.root, np.arange(weights.shape[1]))]
    while stack:
        v, items = stack.pop()
        visited += 1
        if v < 0:
            scores = part_of_score(tree.tfs[~v], tree.m[~v]) @ _columns(weights, tree.paths[~v], items)
            good = scores >= best.least[items]
            best.add(items[good], scores[good], tree.ids[~v])
            continue
        depth, m = tree.depth[v], tree.m_least[v]
        path = tree.paths[tree.path_of[v]][:depth]
        bound = part_of_score(np.int64(tree.tf_below[v]), m) * _row(later, int(path[-1]) + 1 if depth else 0, items)
        if depth:
            bound = bound + part_of_score(tree.tf_max[v], m) @ _columns(weights, path, items)
        items = items[bound >= best.least[items]]
        if len(items):
            stack += [(c, items) for c in reversed(tree.children[v])]
    return visited


def _columns(weights: np.ndarray, path: np.ndarray, items: np.ndarray) -> np.ndarray:
    rows = weights[path]
    return rows if len(items) == weights.shape[1] else rows[:, items]


def _row(later: np.ndarray, rank: int, items: np.ndarray) -> np.ndarray:
    return later[rank] if len(items) == later.shape[1] else later[rank, items]


# --- the job -----------------------------------------------------------------------------

_FOUND = "salt int, item int, score long, doc_id long"


def _search_block(docs: DataFrame, block: Block, k: int, doc_id: str, text: str) -> DataFrame:
    """``item, score, doc_id``: the best of each salted group of tasks; ``item`` is a number in the block."""
    vectors = restricted(docs, block, doc_id, text)
    sums = vectors.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = int(sums["n"] or 0), int(sums["l"] or 0)
    df = document_frequencies(vectors, len(block.names))
    # terms by frequency, frequent ones first: rank of each, and weights by rank
    order = np.lexsort((block.names, -df))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    w = np.array([weight(int(d), n_docs) for d in df[order]], np.int64)
    # whole numbers below 2**53 are exact as doubles, which multiply faster; beyond that they stay integers
    exact = int(w.sum()) * 1_000_000 < 1 << 53
    has = block.has[order]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        weights = (has * w[:, None]).astype(np.float64 if exact else np.int64)
        later = np.zeros((len(weights) + 1, weights.shape[1]), weights.dtype)
        later[:-1] = np.cumsum(weights[::-1], axis=0)[::-1]
        best = Best(weights.shape[1], k)
        for ids, n, paths, tfs in _trees(_vectors(parts), rank):
            m = 10 + (90 * n * n_docs) // n_terms
            search(Tree(ids, m, paths, tfs, k), weights, later, best)
        found = list(best.rows())
        if found:
            item, score, doc = (np.array(x, np.int64) for x in zip(*found, strict=True))
            salt = np.full(len(item), TaskContext.get().partitionId() % SALTS, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(salt), pa.array(item.astype(np.int32)), pa.array(score), pa.array(doc)],
                                             names=[f.split()[0] for f in _FOUND.split(", ")])

    found = vectors.filter("held > 0").select("held", "body").mapInArrow(run, _FOUND)
    return _best(found, ["salt", "item"], k).drop("salt")


def _trees(chunks: Iterator[tuple[np.ndarray, ...]], rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list, list]]:
    """Documents of one tree after the other: ids, numbers of terms, paths and their tf."""
    ids, ns, paths, tfs, total = [], [], [], [], 0
    for i, n, count, term, tf in chunks:
        doc = np.repeat(np.arange(len(i)), count)
        order = np.lexsort((rank[term], doc))
        term, tf = rank[term][order], tf[order]
        end = np.cumsum(count)
        for d, (a, z) in enumerate(zip((end - count).tolist(), end.tolist(), strict=True)):
            ids.append(i[d])
            ns.append(n[d])
            paths.append(term[a:z])
            tfs.append(tf[a:z])
            total += z - a
            if len(ids) >= TREE_DOCUMENTS or total >= TREE_TERMS:
                yield np.array(ids), np.array(ns), paths, tfs
                ids, ns, paths, tfs, total = [], [], [], [], 0
    if ids:
        yield np.array(ids), np.array(ns), paths, tfs


def _best(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: of each item the ``k`` documents of the highest scores above 0, ties by
    ascending id. See the module's text."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    terms = stored(blocks_of(item_terms(items, item_id, item_text)), "item-terms")
    key, out = fresh_key(), None
    item_type = items.schema[item_id].dataType
    for b in [r["block"] for r in terms.select("block").distinct().orderBy("block").toLocalIterator()]:
        block = Block([(r["item"], r["term"]) for r in terms.filter(F.col("block") == b).select("item", "term").collect()], key)
        found = _search_block(docs, block, k, doc_id, text)
        names = spark.createDataFrame(list(enumerate(block.items)), f"item int, item_id {item_type.simpleString()}")
        best = stored(_best(found, ["item"], k).join(F.broadcast(names), "item").select("item_id", "score", "doc_id"), "found")
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = spark.createDataFrame([], f"item_id {item_type.simpleString()}, score long, doc_id long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return out.select("item_id", rank.alias("rank"), F.when(F.col("doc_id") != _LEAST, F.col("doc_id")).alias("doc_id"), "score")
