"""The distributed part of finding repeated windows, shared by the substring operators.

A text is a sequence of symbols (bytes or words); a window is ``width`` symbols of one
document. The question for every window: does the same one start earlier?

1. Copies: documents whose whole text has a smaller document id elsewhere. All their
   windows start earlier, so they take no part in the rest.
2. The others are stored in batches of a few MB (compressed); every later pass scans
   those batches, and small answers are joined to them by batch.
3. Anchors: of the ``gram``-symbol strings inside a window the one with the least name
   stands for the window. Equal windows have equal anchors at equal places, and
   neighbouring windows mostly share theirs, so there are far fewer anchors than
   symbols. Each batch sends its distinct anchor names, split by name into buckets; a
   bucket answers which of them occur elsewhere. Windows of the others are unique.
4. Contexts: a repeated anchor with all symbols of the windows that it stands for.
   Each batch sends each distinct context once, with its first place, split by anchor into
   buckets. A bucket compares the windows of its contexts (the operator's own method)
   and answers with one bit per window.
   An anchor with many contexts (a short string with ever other neighbours) is *heavy*:
   its windows are dealt one by one, by the window's own 64-bit name, each distinct one once
   per batch. Which anchors are heavy comes with the answer of 3, from counts per batch.
5. Every batch applies the answers to its documents.

Whatever a third of all documents share is sent once per batch, be it a passage, or a
window with a short hot string in it; buckets are sized by the data. As every batch has a message for nearly every
bucket, buckets grow with the data before there are more of them: one is worked through in slices by name, each
as large as memory wants it. A lost executor costs the recomputation of its tasks from stored batches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from suitelens.llm.common import TextChunk, partitions_for, prepare, small_enough, stored, text_chunks
from suitelens.llm.words import NOT_SPACE, mix, span_names, split_words, window_names, word_names

BATCH_BYTES = 1 << 20
#: anchor names, and windows of contexts, that one slice of a bucket holds at about (a slice unfolds its
#: windows into a dozen long arrays; what comes packed takes a twentieth of that)
BUCKET_ANCHORS, BUCKET_WINDOWS = 1 << 18, 1 << 18
#: a bucket has up to so many slices, once there are so many buckets
MOST_SLICES, ENOUGH_BUCKETS = 32, 256
#: answers up to this size are broadcast to the batches; larger ones are joined by shuffle
BROADCAST_BYTES = 32 << 20
#: an anchor with more distinct contexts than this is heavy
HEAVY_CONTEXTS = 1 << 12
_SLICE = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)  # low bits of a name that make way for a place within a slice
_BYTE_NAMES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Symbols:
    """How texts become symbols. ``strict``: only smaller documents count as earlier;
    otherwise an earlier start in the same document does too. ``key``: of the words' names."""
    words: bool
    width: int
    gram: int
    strict: bool
    key: int = 0

    def split(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbol names, byte starts and ends of symbols, first and last symbol of each document."""
        if not self.words:
            at = np.arange(len(data) + 1)
            return _BYTE_NAMES[data], at[:-1], at[1:], begin, end
        starts, ends = split_words(data, begin, NOT_SPACE)
        return word_names(data, starts, ends, self.key), starts, ends, np.searchsorted(starts, begin, "left"), np.searchsorted(starts, end, "left")


class Batch:
    """The windows of a batch's documents and their anchors."""

    def __init__(self, kind: Symbols, data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, copy: np.ndarray):
        self.kind, self.data, self.ids, self.copy = kind, data, ids, copy
        end = np.cumsum(sizes)
        self.names, self.starts, self.ends, self.first, self.last = kind.split(data, end - sizes, end)
        grams = window_names_sliced(self.names, kind.gram)
        n = max(0, len(self.names) - kind.width + 1)
        ok = np.zeros(n + 1, np.int8)  # +1 where windows of a document begin, -1 behind them
        has = ~copy & (self.last - self.first >= kind.width)
        np.add.at(ok, self.first[has], 1)
        np.add.at(ok, self.last[has] - kind.width + 1, -1)
        at = np.flatnonzero(np.cumsum(ok[:n]))
        place = _least(grams, kind.width - kind.gram + 1)[at] if n else at
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        cut = np.flatnonzero(new)
        self.low = at[cut]  # first and last window of each anchor
        self.high = at[np.append(cut[1:], len(at)) - 1] if len(at) else at
        self.place = place[cut]
        # least names are small numbers; named anew, they spread evenly over buckets
        self.anchor = mix(grams[self.place] + np.uint64(1)) if len(cut) else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.last, self.low, "right")

    def unique_anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor names in order, and whether each occurs more than once here."""
        names, n = np.unique(self.anchor, return_counts=True)
        return names, n > 1

    def context_counts(self, names: np.ndarray) -> np.ndarray:
        """Distinct contexts here of each of the anchors ``names`` (in order)."""
        if not len(names):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(names, self.anchor), len(names) - 1)
        c = Contexts(self, np.flatnonzero(names[at] == self.anchor))
        return np.bincount(np.searchsorted(names, self.anchor[c.one]), minlength=len(names))

    def contexts(self, chosen: np.ndarray) -> Contexts:
        return Contexts(self, self.rows(chosen))

    def rows(self, chosen: np.ndarray) -> np.ndarray:
        """Anchors' places of the chosen ones of the distinct anchors."""
        return np.flatnonzero(chosen[np.searchsorted(np.unique(self.anchor), self.anchor)])


class Contexts:
    """The distinct contexts of some anchors of a batch, in order of anchor name and first place."""

    def __init__(self, batch: Batch, rows: np.ndarray):
        self.batch, self.rows = batch, rows
        low, high, width = batch.low[rows], batch.high[rows], batch.kind.width
        name = mix(span_names(batch.names, low, high + width) + batch.anchor[rows])
        _, one, self.back = np.unique(name, return_index=True, return_inverse=True)  # one: the first place, as documents are in order
        order = np.argsort(batch.anchor[rows[one]], kind="stable")
        self.back = np.argsort(order)[self.back]
        self.one = rows[one[order]]
        self.windows = batch.high[self.one] - batch.low[self.one] + 1

    def bits_to_starts(self, bits: np.ndarray) -> np.ndarray:
        """Starts of all windows of the batch that start earlier elsewhere; ``bits``: of the contexts' first places."""
        b, strict = self.batch, self.batch.kind.strict
        first = self.one[self.back]  # the first place of each anchor's context
        n = b.high[self.rows] - b.low[self.rows] + 1
        at = np.repeat(b.low[self.rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        begin = (np.cumsum(self.windows) - self.windows)[self.back]
        answer = bits[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] if len(n) else np.zeros(0, bool)
        later = b.ids[b.doc[self.rows]] > b.ids[b.doc[first]]
        if not strict:
            place, place1 = b.place - b.first[b.doc], b.place[first] - b.first[b.doc[first]]
            later |= (b.ids[b.doc[self.rows]] == b.ids[b.doc[first]]) & (place[self.rows] > place1)
        return at[answer | np.repeat(later, n)]


class HeavyWindows:
    """The distinct windows of heavy anchors of a batch, in order of their names."""

    def __init__(self, batch: Batch, rows: np.ndarray):
        self.batch = batch
        n = batch.high[rows] - batch.low[rows] + 1
        self.at = np.repeat(batch.low[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self.doc = np.repeat(batch.doc[rows], n)
        names = mix(span_names(batch.names, self.at, self.at + batch.kind.width)) if len(self.at) else np.zeros(0, np.uint64)
        self.names, self.one, self.back = np.unique(names, return_index=True, return_inverse=True)

    def place(self) -> np.ndarray:
        return self.at - self.batch.first[self.doc]

    def bits_to_starts(self, bits: np.ndarray) -> np.ndarray:
        """Starts of all these windows that start earlier elsewhere; ``bits``: of the distinct ones."""
        ids, place, one = self.batch.ids[self.doc], self.place(), self.one[self.back]
        return self.at[bits[self.back] | starts_later(self.batch.kind, ids, place, ids[one], place[one])]


def starts_later(kind: Symbols, ids: np.ndarray, place: np.ndarray, ids1: np.ndarray, place1: np.ndarray) -> np.ndarray:
    later = ids > ids1
    return later if kind.strict else later | ((ids == ids1) & (place > place1))


def window_names_sliced(names: np.ndarray, width: int) -> np.ndarray:
    """``mix(window_names())``, slice by slice so that it stays in the processor's cache."""
    n = max(0, len(names) - width + 1)
    out = np.empty(n, np.uint64)
    for a in range(0, n, _SLICE):
        out[a:a + _SLICE] = mix(window_names(names[a:min(n, a + _SLICE) + width - 1], width))
    return out


def _least(names: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` names the place of the least, the first of equals."""
    n = len(names) - width + 1
    out = np.empty(max(0, n), np.int64)
    for a in range(0, n, _SLICE):
        part = names[a:min(n, a + _SLICE) + width - 1]
        part = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        m = 1
        while m * 2 <= width:
            part = np.minimum(part[:-m], part[m:])
            m *= 2
        k = min(n, a + _SLICE) - a
        part = np.minimum(part[:k], part[width - m:width - m + k])
        out[a:a + k] = (part & _PLACE).astype(np.int64) + a
    return out


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return (((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def in_buckets(parts: int, least: int) -> tuple[int, int]:
    """Numbers of buckets and of slices in each for at least ``parts`` slices; ``least`` buckets or more."""
    slices = min(MOST_SLICES, max(1, parts // ENOUGH_BUCKETS))
    return max(least, -(-parts // slices)), slices


def by_slice(slice_of: np.ndarray, slices: int) -> Iterator[np.ndarray]:
    """Places of the entries of one slice after the other, each in order."""
    if slices == 1:
        yield np.arange(len(slice_of))
        return
    slice_of = slice_of.astype(np.uint8)
    order = np.argsort(slice_of, kind="stable")
    cut = np.searchsorted(slice_of[order], np.arange(slices + 1))
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if z > a:
            yield order[a:z]


def _runs(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``begin, begin + 1, ...``, ``n`` of each, one after the other."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


# --- the stored batches ------------------------------------------------------------------

_BATCHES = "batch long, n_bytes long, sizes binary, ids binary, copy binary, rest binary, body binary"


def _copies(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id, digest`` of the documents whose text a smaller id has too."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("digest")) \
               .filter("digest is not null")
    least = rows.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return stored(rows.join(least, "digest").filter("id > least").select("id", "digest").distinct(), "copies")


def pack_batches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents in batches: ids, sizes, copy flags, the other columns, and the bytes, in order of ids."""
    copies = _copies(docs, doc_id, text)
    flags = copies.select(F.col("id").alias("_cid"), F.col("digest").alias("_cdigest"), F.lit(True).alias("_copy"))
    if small_enough(copies, "digest", BROADCAST_BYTES):
        flags = F.broadcast(flags)
    key = (F.col(doc_id).cast("long") == F.col("_cid")) & (F.unhex(F.sha2(F.col(text).cast("binary"), 256)) == F.col("_cdigest"))
    rows = docs.join(flags, key, "left").drop("_cid", "_cdigest")
    others = [c for c in rows.columns if c not in (text, "_copy")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import zstandard
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 20
        for batch in batches:
            if not batch.num_rows:
                continue
            number = pc.fill_null(pc.cast(batch.column(others.index(doc_id)), pa.int64()), np.iinfo(np.int64).min)
            batch = batch.take(pa.array(np.argsort(number.to_numpy(zero_copy_only=False), kind="stable")))
            for chunk in text_chunks(iter([batch]), text, BATCH_BYTES):
                ids = chunk_ids(chunk, doc_id)
                rest = pa.BufferOutputStream()
                only = chunk.rows.select(others)
                with pa.ipc.new_stream(rest, only.schema) as w:
                    w.write_batch(only)
                copy = chunk.column("_copy").fill_null(False).to_numpy(zero_copy_only=False)
                pack = zstandard.ZstdCompressor(level=3).compress
                row = (k, len(chunk.data), (chunk.end - chunk.begin).astype("<i8").tobytes(), ids.tobytes(),
                       np.packbits(copy).tobytes(), pack(rest.getvalue().to_pybytes()), pack(chunk.data.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=[f.split()[0] for f in _BATCHES.split(", ")])
                k += 1

    return stored(rows.select(*others, text, "_copy").mapInArrow(run, _BATCHES), "batches", "uncompressed")


def chunk_ids(chunk: TextChunk, doc_id: str) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.cast(chunk.column(doc_id), pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype("<i8")


def open_batch(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and of each document the size, the id and whether it is a copy."""
    import zstandard

    sizes, ids = np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["ids"], "<i8")
    body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, row["n_bytes"])) if row["n_bytes"] else b""
    return np.frombuffer(body, np.uint8), sizes, ids, np.unpackbits(np.frombuffer(row["copy"], np.uint8), count=len(ids)).astype(bool)


def other_columns(row: dict) -> pa.RecordBatch:
    """The documents' columns besides the text."""
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])).read_next_batch()


def _open(kind: Symbols, row: dict) -> Batch:
    return Batch(kind, *open_batch(row))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):  # a batch of documents at a time as Python objects
            yield batch.slice(k, 1).to_pylist()[0]


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of one bucket after the other; they come sorted."""
    held: list[dict] = []
    for row in rows_of(batches):
        if held and held[0]["bucket"] != row["bucket"]:
            yield held[0]["bucket"], held
            held = []
        held.append(row)
    if held:
        yield held[0]["bucket"], held


def dealt(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket", "batch")


# --- anchors ----------------------------------------------------------------------------

_SENT = "bucket long, batch long, n long, n_once long, body binary, counts binary"
_ANSWER = "batch long, bucket long, n_set long, n_heavy long, bits binary"


def emit(rows: list[tuple], fields: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in fields.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)


def _shared_names(names: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which names occur several times, and which have counts of more than ``most`` together."""
    order = np.argsort(names)
    same = names[order[1:]] == names[order[:-1]]
    again, heavy = np.zeros(len(names), bool), np.empty(len(names), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    first = np.flatnonzero(np.append(True, ~same))
    heavy[order] = np.repeat(np.add.reduceat(count[order].astype(np.int64), first) > most, np.diff(np.append(first, len(names))))
    return again, heavy


def _repeated_anchors(batches: DataFrame, kind: Symbols, buckets: int, most: int, slices: int = 1) -> DataFrame:
    """For each batch and bucket, which of its anchors occur elsewhere, and which have more
    than ``most`` contexts; ``n_set``, ``n_heavy``: contexts of the light and the heavy ones."""
    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(parts):
            batch = _open(kind, row)
            names, many = batch.unique_anchors()
            count = np.ones(len(names), "<u4")
            count[many] = batch.context_counts(names[many])
            cut = np.searchsorted(bucket_of(names, buckets), np.arange(buckets + 1))
            out = []
            for b in np.flatnonzero(np.diff(cut)).tolist():
                part, m, n = (x[cut[b]:cut[b + 1]] for x in (names, many, count))
                part = np.concatenate([part[~m], part[m]])  # 48 bits and the bucket are enough: this is a filter
                out.append((b, row["batch"], len(part), int((~m).sum()), part.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(),
                            zlib.compress(n[m].tobytes(), 1)))
            if out:
                yield emit(out, _SENT)

    def answer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in by_bucket(parts):
            names = np.zeros((sum(r["n"] for r in rows), 8), np.uint8)
            names[:, :6] = np.frombuffer(b"".join(r["body"] for r in rows), np.uint8).reshape(-1, 6)
            names = names.view("<u8").ravel()
            count = np.concatenate([np.append(np.ones(r["n_once"], "<u4"), np.frombuffer(zlib.decompress(r["counts"]), "<u4")) for r in rows])
            again, heavy = np.zeros(len(names), bool), np.zeros(len(names), bool)
            for mine in by_slice(names % np.uint64(slices), slices):
                again[mine], heavy[mine] = _shared_names(names[mine], count[mine], most)
            at, out = 0, []
            for r in rows:
                part = slice(at, at + r["n"])
                bits = again[part]
                bits[r["n_once"]:] = True
                at += r["n"]
                if bits.any():
                    both = np.stack([bits, bits & heavy[part]])
                    n_heavy = int(count[part][both[1]].sum(dtype=np.int64))
                    out.append((r["batch"], b, int(count[part][bits].sum(dtype=np.int64)) - n_heavy, n_heavy, zlib.compress(np.packbits(both).tobytes())))
            if out:
                yield emit(out, _ANSWER)

    sent = batches.mapInArrow(send, _SENT)
    return stored(dealt(sent, buckets).mapInArrow(answer, _ANSWER), "anchors")


def with_answers(batches: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """Each batch with its answers as the array ``name``."""
    one = answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))  # bounded by a batch
    if small_enough(answers, "bits", BROADCAST_BYTES):
        one = F.broadcast(one)
    return batches.join(one, "batch", "left")


def _bits(answers: list | None, *counts: np.ndarray) -> list[np.ndarray]:
    """Answers of all buckets, in order of buckets; a bucket without one has no bit set.
    Each holds as many parts as there are ``counts`` (by bucket), one after the other."""
    ends = [np.cumsum(c) for c in counts]
    outs = [np.zeros(int(e[-1]) if len(e) else 0, bool) for e in ends]
    for a in answers or ():
        b, at = a["bucket"], 0
        bits = np.unpackbits(np.frombuffer(zlib.decompress(a["bits"]), np.uint8)).astype(bool)
        for out, c, end in zip(outs, counts, ends, strict=True):
            n = int(c[b])
            out[end[b] - n:end[b]] = bits[at:at + n]
            at += n
    return outs


def _alive(batch: Batch, answers: list | None, buckets: int) -> tuple[Contexts, HeavyWindows]:
    """Contexts of the light repeated anchors, and the windows of the heavy ones."""
    names, many = batch.unique_anchors()
    bucket = bucket_of(names, buckets)
    order = np.lexsort((many, bucket))  # as it was sent: in each bucket those that occur once first
    n = np.bincount(bucket, minlength=buckets)
    repeated, heavy = np.zeros(len(names), bool), np.zeros(len(names), bool)
    repeated[order], heavy[order] = _bits(answers, n, n)
    return batch.contexts(repeated & ~heavy), HeavyWindows(batch, batch.rows(heavy))


def _counts(c: Contexts, h: HeavyWindows, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of contexts, and windows of heavy anchors, that a batch sends to each bucket."""
    return (np.bincount(bucket_of(c.batch.anchor[c.one], buckets), weights=c.windows, minlength=buckets).astype(np.int64),
            np.bincount(bucket_of(h.names, buckets), minlength=buckets))


# --- contexts ---------------------------------------------------------------------------

_CONTEXTS = "bucket long, batch long, body binary, heavy binary"


def _pack_contexts(c: Contexts, cut: np.ndarray) -> bytes:
    """The contexts ``cut[0]`` to ``cut[-1]``, each slice up to the next of ``cut``."""
    import zstandard

    rows = slice(int(cut[0]), int(cut[-1]))
    b, one = c.batch, c.one[rows]
    begin, end = b.starts[b.low[one]], b.ends[b.high[one] + b.kind.width - 1]
    n = end - begin
    data = b.data[_runs(begin, n)]
    doc = b.doc[one]
    raw = b"".join([np.diff(cut).astype("<u4").tobytes(), b.ids[doc].astype("<i8").tobytes(), (b.place[one] - b.first[doc]).astype("<i8").tobytes(),
                    n.astype("<u4").tobytes(), c.windows[rows].astype("<u2").tobytes(), data.tobytes()])
    return struct.pack("<Q", len(raw)) + zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack_contexts(body: bytes, slices: int = 1) -> tuple[np.ndarray, ...]:
    """The slice of each context, ids, places, sizes, numbers of windows, and the bytes."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(body[8:], max_output_size=struct.unpack_from("<Q", body)[0])
    of_slice = np.repeat(np.arange(slices, dtype=np.uint8), np.frombuffer(raw, "<u4", slices))
    n, at = len(of_slice), 4 * slices
    out = [of_slice]
    for dtype in ("<i8", "<i8", "<u4", "<u2"):
        out.append(np.frombuffer(raw, dtype, n, at).astype(np.int64))
        at += n * np.dtype(dtype).itemsize
    return (*out, np.frombuffer(raw, np.uint8, offset=at))


def _pack_heavy(h: HeavyWindows, part: slice) -> bytes:
    import zstandard

    one = h.one[part]
    raw = [h.batch.ids[h.doc[one]], h.place()[one], h.names[part]]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in raw))


def _unpack_heavy(body: bytes) -> np.ndarray:
    """Ids, places and names."""
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8) if body else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(3, 8, -1 if len(raw) else 0).transpose(0, 2, 1)).view("<i8")[:, :, 0]


def _sent_windows(batches: DataFrame, kind: Symbols, anchor_buckets: int, buckets: int, slices: int = 1) -> DataFrame:
    """What each batch sends to each bucket, in order of its slices; ``batches`` has the anchors' answers."""
    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(parts):
            if not row["anchors"]:
                continue
            c, h = _alive(_open(kind, row), row["anchors"], anchor_buckets)
            cut = np.searchsorted(bucket_of(c.batch.anchor[c.one], buckets * slices), np.arange(buckets * slices + 1))
            cut_h = np.searchsorted(bucket_of(h.names, buckets), np.arange(buckets + 1))
            out = []
            for k in np.flatnonzero(np.diff(cut[::slices]) + np.diff(cut_h)).tolist():
                out.append((k, row["batch"], _pack_contexts(c, cut[k * slices:(k + 1) * slices + 1]),
                            _pack_heavy(h, slice(cut_h[k], cut_h[k + 1])) if cut_h[k + 1] > cut_h[k] else b""))
            if out:
                yield emit(out, _CONTEXTS)

    return batches.mapInArrow(send, _CONTEXTS)


def _later_contexts(kind: Symbols, ids: np.ndarray, place: np.ndarray, size: np.ndarray, windows: np.ndarray, data: np.ndarray,
                    compare: Callable) -> np.ndarray:
    """One bit for each window of the contexts, in the order in which they came."""
    # contexts in order of their place in the corpus, so that the first of equal windows is the earliest
    order = np.lexsort((place, ids))
    end = np.cumsum(size)
    names, _, _, first, _ = kind.split(data, end - size, end)
    n = windows[order]
    at = np.repeat(first[order] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    bits = np.zeros(len(at), bool)
    if not len(at):
        return bits
    group = compare(names, at)  # equal windows have equal numbers
    who = np.repeat(order, n)
    earliest = np.full(int(group.max()) + 1, -1, np.int64)
    earliest[group[::-1]] = who[::-1]
    one = earliest[group]
    begin = np.cumsum(windows) - windows
    bits[np.repeat(begin[order] - (np.cumsum(n) - n), n) + np.arange(len(at))] = starts_later(kind, ids[who], place[who], ids[one], place[one])
    return bits


def _later_heavy(kind: Symbols, ids: np.ndarray, place: np.ndarray, names: np.ndarray) -> np.ndarray:
    """One bit for each window, in the order in which they came."""
    order = np.lexsort((place, ids, names))
    first = np.flatnonzero(np.append(True, names[order][1:] != names[order][:-1])) if len(names) else order
    one = np.empty(len(names), np.int64)
    one[order] = np.repeat(order[first], np.diff(np.append(first, len(names))))
    return starts_later(kind, ids, place, ids[one], place[one])


def _in_slices(kind: Symbols, found: list[tuple], compare: Callable, slices: int) -> np.ndarray:
    """``_later_contexts`` of a whole bucket, slice by slice: equal windows have equal anchors, so they are in one."""
    of_slice, ids, place, size, windows, data = (np.concatenate(x) for x in zip(*found, strict=True))
    if slices == 1:
        return _later_contexts(kind, ids, place, size, windows, data, compare)
    bits = np.zeros(int(windows.sum()), bool)
    begin, first = np.cumsum(size) - size, np.cumsum(windows) - windows
    for mine in by_slice(of_slice, slices):
        bits[_runs(first[mine], windows[mine])] = _later_contexts(
            kind, ids[mine], place[mine], size[mine], windows[mine], data[_runs(begin[mine], size[mine])], compare)
    return bits


def _heavy_in_slices(kind: Symbols, found: list[np.ndarray], slices: int) -> np.ndarray:
    """``_later_heavy`` of a whole bucket, slice by slice."""
    ids, place, names = np.concatenate(found, axis=1)
    bits = np.zeros(len(names), bool)
    for mine in by_slice(names.view(np.uint64) % np.uint64(slices), slices):
        bits[mine] = _later_heavy(kind, ids[mine], place[mine], names[mine])
    return bits


def _earlier(batches: DataFrame, kind: Symbols, anchor_buckets: int, buckets: int, compare: Callable, slices: int = 1) -> DataFrame:
    """``batches`` has the anchors' answers; the windows' answers come back."""
    def answer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in by_bucket(parts):
            heavy = [_unpack_heavy(r["heavy"]) for r in rows]
            bits_h, n_heavy = _heavy_in_slices(kind, heavy, slices), [g.shape[1] for g in heavy]
            del heavy
            found = [_unpack_contexts(r["body"], slices) for r in rows]
            bits, n = _in_slices(kind, found, compare, slices), [int(f[4].sum()) for f in found]
            del found
            k, k_h, out = 0, 0, []
            for r, m, m_h in zip(rows, n, n_heavy, strict=True):
                mine = np.concatenate([bits[k:k + m], bits_h[k_h:k_h + m_h]])
                if mine.any():
                    out.append((r["batch"], b, int(mine.sum()), int(mine[m:].sum()), zlib.compress(np.packbits(mine).tobytes())))
                k += m
                k_h += m_h
            if out:
                yield emit(out, _ANSWER)

    sent = _sent_windows(batches, kind, anchor_buckets, buckets, slices)
    return stored(dealt(sent, buckets).mapInArrow(answer, _ANSWER), "windows")


# --- the whole --------------------------------------------------------------------------

ADDED = "n_symbols long, n_removed long, spans array<struct<start: long, stop: long>>, kept binary"


def remove_repeats(docs: DataFrame, kind: Symbols, compare: Callable, doc_id: str = "doc_id", text: str = "text",
                   whole_characters: bool = False) -> DataFrame:
    """``docs`` without the column ``text`` and with ``n_symbols``, ``n_removed``, ``spans``
    (removed runs, in symbols) and ``kept`` (UTF-8; words are joined by one space). Columns
    of ``docs`` with these names are replaced. ``compare(names, starts)`` numbers windows:
    equal ones get equal numbers. ``whole_characters``: spans of bytes shrink to characters."""
    spark = docs.sparkSession
    prepare(spark)
    added = T._parse_datatype_string(ADDED)
    docs = docs.select(*[c for c in docs.columns if c not in added.names or c in (doc_id, text)])
    batches = pack_batches(docs, doc_id, text)
    total = int(batches.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0)
    spread = max(12, min(ENOUGH_BUCKETS, partitions_for(total, 8 * BATCH_BYTES)))
    symbols = total // (6 if kind.words else 1)
    anchor_buckets, slices = in_buckets(partitions_for(2 * symbols // (kind.width - kind.gram + 2), BUCKET_ANCHORS), spread)
    anchors = _repeated_anchors(batches, kind, anchor_buckets, HEAVY_CONTEXTS, slices)
    sums = anchors.agg(F.sum("n_set").alias("light"), F.sum("n_heavy").alias("heavy")).first()
    windows = (int(sums["light"] or 0) + int(sums["heavy"] or 0)) * (kind.width - kind.gram + 1)  # at most
    buckets, slices = in_buckets(partitions_for(windows, BUCKET_WINDOWS), spread)
    with_anchors = with_answers(batches, anchors.select("batch", "bucket", "bits"), "anchors")
    windows = _earlier(with_anchors.select("batch", "n_bytes", "sizes", "ids", "copy", "body", "anchors"),
                       kind, anchor_buckets, buckets, compare, slices)
    both = with_answers(with_anchors, windows.select("batch", "bucket", "bits"), "windows")

    kept_columns = [f for f in docs.schema if f.name != text]
    schema = T.StructType([*kept_columns, *added.fields])

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(parts):
            b = _open(kind, row)
            gone = np.zeros(len(b.names) + 1, np.int32)
            if row["windows"] or row["anchors"]:
                c, h = _alive(b, row["anchors"], anchor_buckets)
                bits, bits_h = _bits(row["windows"], *_counts(c, h, buckets))
                at = np.concatenate([c.bits_to_starts(bits), h.bits_to_starts(bits_h)])
                np.add.at(gone, at, 1)
                np.add.at(gone, at + kind.width, -1)
            whole = b.copy & (b.last - b.first >= kind.width)
            np.add.at(gone, b.first[whole], 1)
            np.add.at(gone, b.last[whole], -1)
            gone = np.cumsum(gone[:-1]) > 0
            out = [], [], [], []
            for a, z in zip(b.first.tolist(), b.last.tolist(), strict=True):
                mine = gone[a:z]
                if whole_characters:
                    mine = _whole_characters(b.data[a:z], mine)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                out[0].append(z - a)
                out[1].append(int(mine.sum()))
                out[2].append([{"start": s, "stop": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                if kind.words:
                    left = a + np.flatnonzero(~mine)
                    out[3].append(b" ".join([b.data[s:e].tobytes() for s, e in zip(b.starts[left].tolist(), b.ends[left].tolist(), strict=True)]))
                else:
                    out[3].append(b.data[a:z][~mine].tobytes())
            rest = other_columns(row)
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [rest.column(rest.schema.get_field_index(f.name)) for f in kept_columns] +
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], span), pa.array(out[3], pa.binary())],
                names=schema.names)

    return both.mapInArrow(finish, schema)


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Keep a character whole if any of its bytes stays."""
    if not gone.any() or not len(data):
        return gone
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    stays = np.zeros(char[-1] + 1 if len(char) else 0, bool)
    stays[char[~gone]] = True
    return ~stays[char]
