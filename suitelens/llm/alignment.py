"""Alignment of two tokenizers' ids by galloping intersection of token ends.

Tokenizer A encodes a space and the text, tokenizer B the text (it puts the space there itself). Places
where tokens of both end cut the text into groups; the A and B ids of a group are linked.

1. Texts are cut before each space that follows no white space. Neither tokenizer has a token across such a
   cut (a worker looks at both vocabularies; if one had, whole texts would be encoded), so a
   *segment*, a word with what sticks to it, is encoded for itself, once per worker, and is a unit of
   alignment: both sides end with it.
2. The ends of all distinct segments of a chunk of documents make two sorted lists. The shorter one drives: each of its ends
   gallops, from its segment's begin, by steps of 1, 2, 4, ... into the longer one until it is passed, and
   a binary search finds its place between. Ends that are in both slice the groups; differences of ranks
   are the ranges of A and B tokens that overlap.
3. Chunks are stored: segments of each document, ids and groups of each distinct segment. An id pair's count, in how many
   documents it is linked, is summed per task before the shuffle.
4. Counts of pairs come back as sorted arrays of bounded size, a range of pairs at a time; every range
   is a pass over the stored chunks, and the sums of the passes are added up.

Defined cases: a null or empty text has no tokens; so has one whose A or B tokens' bytes, joined, are not a
space and the text; rows with one id are documents of their own; a null id stays null; an empty table
gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitelens.llm.common import prepare, stored

#: text of one chunk, in characters; segments that a worker remembers, and that it encodes as one text
CHUNK_CHARS, REMEMBERED, LEARN_SEGMENTS = 1 << 20, 1 << 18, 1 << 14
#: pairs whose counts one pass takes along (20 bytes each), and pairs that a task holds before it sends them
PASS_PAIRS, HELD_PAIRS = 1 << 21, 1 << 20
_FLAGS, _STEP = 1 << 22, 1 << 17
_SPACE_AFTER_SPACE = re.compile(r"\s |\A | \Z")
_CUT = re.compile(r"(?<=\S) (?!\Z)")


# --- galloping ---------------------------------------------------------------------------

def gallop(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each of ``short`` the first place in ``long``, from ``start`` on, that is not
    below it (``len(long)`` if there is none). Exponential steps, then binary search, all at once."""
    n = len(long)
    low = np.minimum(start, n)  # everything before it is below
    step = np.ones(len(short), np.int64)
    high = low.copy()  # the last place that was tried
    going = np.arange(len(short))
    while len(going):
        at = high[going]
        below = np.zeros(len(going), bool)
        inside = at < n
        below[inside] = long[at[inside]] < short[going[inside]]
        going = going[below]
        low[going] = high[going] + 1
        high[going] = np.minimum(high[going] + step[going], n)
        step[going] *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        below = long[middle] < short[open_]
        low[open_] = np.where(below, middle + 1, low[open_])
        high[open_] = np.where(below, high[open_], middle)
        open_ = open_[low[open_] < high[open_]]
    return low


def common_ends(a: np.ndarray, b: np.ndarray, part_a: np.ndarray | None = None, part_b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ranks, in the rising lists ``a`` and ``b``, of the ends that are in both. ``part_a``, ``part_b``: for
    each end a place in the other list before which nothing can equal it."""
    if len(a) > len(b):
        there, here = common_ends(b, a, part_b, part_a)
        return here, there
    at = gallop(a, b, np.zeros(len(a), np.int64) if part_a is None else part_a)
    found = np.flatnonzero((at < len(b)) & (b[np.minimum(at, max(0, len(b) - 1))] == a)) if len(b) else np.zeros(0, np.int64)
    return found, at[found]


# --- the two tokenizers ------------------------------------------------------------------

class Tokenizers:
    """Both tokenizers, and the alignment of segments that this worker has met."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        import sentencepiece
        import tiktoken

        with open(path_a, "rb") as f:
            ranks = {base64.b64decode(piece): int(i) for piece, i in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})  # nothing in a text is special
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes_a[i] = piece
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # how an id is written: within a group, and as its group's last one of that side
        self.names = [str(i) + mark for t, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for i in range(len(t)) for mark in marks]
        # no token may reach over the cut before a space
        self.by_segment = not any(re.search(r"\S ", t.decode("utf-8", "ignore")) for t in self.bytes_a) and \
            not any(re.search("[^▁]▁", p) for p in pieces)
        self.known: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        """Empty the worker's memory of segments (it is bounded)."""
        self.known.clear()
        self.strings: list[str | None] = []  # the groups' text, with a ";" behind each; none where the tokens are not the segment
        self.pools = [np.zeros(1 << 16, np.uint32) for _ in range(4)]  # A and B ids, group sizes in A and B tokens
        self.ends = [np.zeros(1 << 16, np.int64) for _ in range(3)]  # of each segment in the pools: A ids, B ids, groups

    def segments(self, text: str) -> list[str]:
        """The text in segments, each without the space before it."""
        if not self.by_segment:
            return [text]
        return text.split(" ") if not _SPACE_AFTER_SPACE.search(text) else _CUT.split(text)

    def learn(self, texts: list[str]) -> None:
        """Encode and align new segments: those that end with white space one by one, the
        others as one text, since no token reaches over the cut between them."""
        alone = [t for t in texts if not t or t[-1].isspace()] if self.by_segment else texts
        for t in alone:
            self._learn([t])
        together = [t for t in texts if t and not t[-1].isspace()] if self.by_segment else []
        for k in range(0, len(together), LEARN_SEGMENTS):
            self._learn(together[k:k + LEARN_SEGMENTS])

    def _learn(self, texts: list[str]) -> None:
        joined = " ".join(texts)
        raw = (" " + joined).encode()
        a, b = self.a.encode_ordinary(" " + joined), self.b.encode(joined, num_threads=1)
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            if len(texts) > 1:  # which segment is it?
                half = len(texts) // 2
                self._learn(texts[:half])
                self._learn(texts[half:])
                return
            self._keep(texts, [None], [np.zeros(0, np.uint32)] * 4, [np.zeros(1, np.int64)] * 3)
            return
        a, b = np.array(a, np.uint32), np.array(b, np.uint32)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        end = np.cumsum([len(t) + 1 if t.isascii() else len(t.encode()) + 1 for t in texts])
        # every segment ends with a token of both: groups stay within segments, and each end's search starts at its segment
        seg_a, seg_b = np.searchsorted(end_a, end) + 1, np.searchsorted(end_b, end) + 1
        n_a, n_b = np.diff(seg_a, prepend=0), np.diff(seg_b, prepend=0)
        at_a, at_b = common_ends(end_a, end_b, np.repeat(seg_b - n_b, n_a), np.repeat(seg_a - n_a, n_b))
        size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        seg_g = np.searchsorted(at_a, seg_a - 1) + 1
        # all ids in the order of the groups' text, each with the mark that follows it
        m, n = len(a), len(b)
        group_a, group_b = np.repeat(np.arange(len(at_a)), size_a), np.repeat(np.arange(len(at_b)), size_b)
        last_a, last_b = np.zeros(m, bool), np.zeros(n, bool)
        last_a[at_a], last_b[at_b] = True, True
        order = np.empty(m + n, np.int64)
        order[np.arange(m) + (at_b + 1 - size_b)[group_a]] = 2 * a.astype(np.int64) + last_a
        order[np.arange(n) + (at_a + 1)[group_b]] = 2 * (len(self.bytes_a) + b.astype(np.int64)) + last_b
        names = list(map(self.names.__getitem__, order.tolist()))
        cut = (seg_a + seg_b).tolist()
        self._keep(texts, ["".join(names[c:z]) for c, z in zip([0, *cut[:-1]], cut, strict=True)], [a, b, size_a, size_b], [seg_a, seg_b, seg_g])

    def _keep(self, texts: list[str], strings: list, ids: list[np.ndarray], ends: list[np.ndarray]) -> None:
        k = len(self.strings)
        self.known.update(zip(texts, range(k, k + len(texts)), strict=True))
        self.strings += strings
        used = [int(e[k - 1]) if k else 0 for e in self.ends]
        for p, x in enumerate(ids):
            self.pools[p] = _room(self.pools[p], used[min(p, 2)] + len(x))
            self.pools[p][used[min(p, 2)]:used[min(p, 2)] + len(x)] = x
        for p, x in enumerate(ends):
            self.ends[p] = _room(self.ends[p], k + len(x))
            self.ends[p][k:k + len(x)] = used[p] + x

    def facts(self, which: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of known segments: numbers of A ids, B ids and groups; and these, one after the other."""
        counts, out = [], []
        for e in self.ends:
            begin = np.where(which > 0, e[which - 1], 0)
            counts.append(e[which] - begin)
            out.append(np.repeat(begin - (np.cumsum(counts[-1]) - counts[-1]), counts[-1]) + np.arange(int(counts[-1].sum())))
        return counts, [pool[out[min(p, 2)]] for p, pool in enumerate(self.pools)]

    def tidy(self) -> None:
        if len(self.known) > REMEMBERED or len(self.pools[0]) > 16 * REMEMBERED:
            self._forget()


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(len(x), n - len(x)), x.dtype)])


_loaded: dict[tuple[str, str, str], Tokenizers] = {}


def tokenizers(*files: str) -> Tokenizers:
    if files not in _loaded:
        _loaded[files] = Tokenizers(*files)
    return _loaded[files]


# --- chunks ------------------------------------------------------------------------------

_CHUNK = ("chunk long, n_docs long, ids binary, missing binary, digests binary, n_segments binary, segments binary, "
          "n_a binary, n_b binary, n_groups binary, ids_a binary, ids_b binary, size_a binary, size_b binary")


def _pack(x: np.ndarray, dtype: str = "<u4") -> bytes:
    """Little numbers, low bytes together, compressed."""
    import zstandard

    planes = np.ascontiguousarray(x.astype(dtype)).view(np.uint8).reshape(-1, np.dtype(dtype).itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(body: bytes, dtype: str = "<u4") -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(body), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, total = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if texts and total + len(t or "") > CHUNK_CHARS:
                yield ids, texts
                ids, texts, total = [], [], 0
            ids.append(i)
            texts.append(t or "")
            total += len(t or "") + 16
    if texts:
        yield ids, texts


def align_chunk(tools: Tokenizers, ids: list, texts: list[str]) -> dict:
    """Segments, ids and groups of a chunk of documents."""
    tools.tidy()
    cut = [tools.segments(t) if t else [] for t in texts]
    distinct = dict.fromkeys(itertools.chain.from_iterable(cut))
    known = tools.known
    new = [s for s in distinct if s not in known]
    if new:
        tools.learn(new)
    distinct = dict(zip(distinct, range(len(distinct)), strict=True))
    which = np.array(list(map(known.__getitem__, distinct)), np.int64)
    strings = [tools.strings[k] for k in which.tolist()]
    wrong = {k for k, s in enumerate(strings) if s is None}
    n_segments, segments, digests = [], [], []
    for c in cut:
        mine = list(map(distinct.__getitem__, c))
        if wrong and not wrong.isdisjoint(mine):
            mine = []
        n_segments.append(len(mine))
        segments.extend(mine)
        digests.append(hashlib.sha256("".join(map(strings.__getitem__, mine))[:-1].encode()).digest() if mine else bytes(32))
    counts, ids_sizes = tools.facts(which)
    return {"n_docs": len(ids), "ids": np.array([0 if i is None else i for i in ids], "<i8").tobytes(),
            "missing": np.packbits(np.array([i is None for i in ids], bool)).tobytes(), "digests": b"".join(digests),
            "n_segments": _pack(np.array(n_segments, np.int64)), "segments": _pack(np.array(segments, np.int64))} | {
            k: _pack(x) for k, x in zip(("n_a", "n_b", "n_groups", "ids_a", "ids_b", "size_a", "size_b"), [*counts, *ids_sizes], strict=True)}


class Chunk:
    """A stored chunk: documents as runs of segments, and the links of each distinct segment."""

    def __init__(self, row: dict):
        get = {k: _unpack(row[k]).astype(np.int64) for k in ("n_segments", "segments", "n_a", "n_b", "n_groups", "ids_a", "ids_b", "size_a", "size_b")}
        self.n_segments, self.segments = get["n_segments"], get["segments"]
        self.n_a, self.n_b, self.n_groups = get["n_a"], get["n_b"], get["n_groups"]
        # all links of a group: each of its A tokens with each of its B tokens
        s_a, s_b = get["size_a"], get["size_b"]
        first_a, first_b = np.cumsum(s_a) - s_a, np.cumsum(s_b) - s_b
        n = s_a * s_b
        group = np.repeat(np.arange(len(n)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.a = get["ids_a"][first_a[group] + place // s_b[group]]
        self.b = get["ids_b"][first_b[group] + place % s_b[group]]
        segment = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        self.n_links = np.bincount(segment, weights=n, minlength=len(self.n_groups)).astype(np.int64)

    def pairs(self) -> np.ndarray:
        return (self.a << 32) | self.b

    def per_document(self, of_segment: np.ndarray) -> np.ndarray:
        """Sum over each document's segments."""
        sums = np.concatenate([[0], np.cumsum(of_segment[self.segments])])
        end = np.cumsum(self.n_segments)
        return sums[end] - sums[end - self.n_segments]

    def per_segment(self, of_link: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of_link)])
        end = np.cumsum(self.n_links)
        return sums[end] - sums[end - self.n_links]

    def document_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct linked pairs, and in how many of the documents each is."""
        names, code = np.unique(self.pairs(), return_inverse=True)
        first = np.cumsum(self.n_links) - self.n_links
        end = np.cumsum(self.n_segments)
        counts = np.zeros(len(names), np.int64)
        rows = max(1, _FLAGS // max(1, len(names)))
        for d in range(0, len(end), rows):  # some documents at a time: a flag for each of them and each pair
            last = min(d + rows, len(end))
            at, stop = int(end[d] - self.n_segments[d]), int(end[last - 1])
            doc = np.repeat(np.arange(last - d), self.n_segments[d:last])
            flags = np.zeros((last - d, len(names)), bool)
            for k in range(0, stop - at, _STEP):
                segment = self.segments[at + k:min(stop, at + k + _STEP)]
                m = self.n_links[segment]
                link = np.repeat(first[segment] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                flags[np.repeat(doc[k:k + len(segment)], m), code[link]] = True
            counts += flags.sum(0)
        return names[counts > 0], counts[counts > 0]


# --- the job -----------------------------------------------------------------------------

def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in parts:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def write_alignment(docs: DataFrame, path_a: str, path_b: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents tokenised and aligned, in stored chunks (``_CHUNK``)."""
    names = [f.split()[0] for f in _CHUNK.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tools, number = tokenizers(path_a, path_b, pattern), TaskContext.get().partitionId() << 32
        for ids, texts in _chunks(parts):
            row = align_chunk(tools, ids, texts) | {"chunk": number}
            yield pa.RecordBatch.from_arrays([pa.array([row[c]]) for c in names], names=names)
            number += 1

    return stored(docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, _CHUNK), "aligned", "uncompressed")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``pair, n, best``: an A id (high 32 bits) and a B id, in how many documents they are linked, and
    whether no other B id has more with that A id."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts)], names=["pair", "n"])

        for row in _rows(parts):
            more, n = Chunk(row).document_pairs()
            names, back = np.unique(np.concatenate([names, more]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(names)).astype(np.int64)
            if len(names) > HELD_PAIRS:
                yield out()
                names, counts = names[:0], counts[:0]
        if len(names):
            yield out()

    needed = chunks.drop("ids", "missing", "digests")
    counted = stored(needed.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    most = counted.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return stored(counted.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


_SUMS = "chunk long, k int, n_best long, count_sum long"


def _sums_of(chunks: DataFrame, pairs: DataFrame, low: int, high: int | None) -> DataFrame:
    """Sums over the links whose pair lies in the range: of documents with any."""
    some = pairs.filter(F.col("pair") >= low) if high is None else pairs.filter(F.col("pair").between(low, high - 1))
    found = some.orderBy("pair").toArrow()
    names, n, best = (found.column(k).to_numpy() for k in range(3))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(parts):
            c = Chunk(row)
            mine = c.pairs()
            at = np.minimum(np.searchsorted(names, mine), max(0, len(names) - 1))
            hit = names[at] == mine if len(names) else np.zeros(len(mine), bool)
            count, top = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64)
            count[hit], top[hit] = n[at[hit]], best[at[hit]]
            count, top = c.per_document(c.per_segment(count)), c.per_document(c.per_segment(top))
            k = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), row["chunk"], np.int64)), pa.array(k.astype(np.int32)), pa.array(top[k]), pa.array(count[k])],
                                             names=["chunk", "k", "n_best", "count_sum"])

    return stored(chunks.drop("ids", "missing", "digests").mapInArrow(run, _SUMS), "link-sums")


def _ranges(pairs: DataFrame, most: int) -> list[tuple[int, int | None]]:
    """Ranges of pairs with at most about ``most`` each: bounds from counts by A id, an id's
    own range being cut by B ids only if it alone has more."""
    total = pairs.count()
    if total <= most:
        return [(0, None)]
    bounds = pairs.stat.approxQuantile("pair", [k / (-(-2 * total // most)) for k in range(1, -(-2 * total // most))], 0.1 * most / total)
    edges = sorted({0, *(int(b) for b in bounds)})
    return list(zip(edges, [*edges[1:], None], strict=True))


_FACTS = "chunk long, k int, doc_id long, n_a long, n_b long, n_groups long, n_links long, digest binary"


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
          pass_pairs: int = PASS_PAIRS) -> DataFrame:
    """``path_a``: ranks of a byte-level vocabulary, ``pattern``: how it splits texts; ``path_b``: a piece model.
    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest`` for every row; ``digest``: sha256 of
    the groups' text, null without tokens. See the module's text."""
    prepare(docs.sparkSession)
    chunks = write_alignment(docs, path_a, path_b, pattern, doc_id, text)
    pairs = pair_counts(chunks)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(parts):
            c, m = Chunk(row), row["n_docs"]
            ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=np.unpackbits(np.frombuffer(row["missing"], np.uint8), count=m).astype(bool))
            n = [c.per_document(x) for x in (c.n_a, c.n_b, c.n_groups, c.n_links)]
            digest = pa.array([row["digests"][32 * k:32 * k + 32] if s else None for k, s in enumerate(c.n_segments.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, row["chunk"], np.int64)), pa.array(np.arange(m, dtype=np.int32)), ids, *map(pa.array, n), digest],
                                             names=[f.split()[0] for f in _FACTS.split(", ")])

    facts = chunks.mapInArrow(run, _FACTS)
    sums = None
    for low, high in _ranges(pairs, pass_pairs):
        more = _sums_of(chunks, pairs, low, high)
        sums = more if sums is None else sums.unionByName(more)
    sums = sums.groupBy("chunk", "k").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return facts.join(sums, ["chunk", "k"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "digest")
