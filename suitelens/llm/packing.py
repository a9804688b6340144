"""Packing: order-preserving dynamic programming over window cuts.

Documents are range-partitioned by id and laid end to end in id order. A window is a
run of at most ``size`` ids; its cost is its padding plus a penalty for its last cut
(none at a document's end, some at a sentence's end, more elsewhere). The least total
over all ways to cut is found by dynamic programming over the cuts allowed: with
padding ``size - (b - a)`` the best earlier cut is the least ``cost(a) + a`` of a sliding
window, which a monotone queue holds, so every transition takes constant time. A window
of a power of two needs no padding; those are extra transitions. Cuts are allowed at
document and sentence ends, in longer stretches without one at every quarter window, and
before the end of the run at powers of two.

A task optimises runs of whole documents of about ``RUN_IDS`` ids (or one document); a
sequence never crosses runs, which costs at most one padded window for each.

Defined cases: a null text has the end id only; null ids sort first, rows with one id
follow each other by text; an empty table gives no piece; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from suitelens.llm.common import partitions_for, prepare, stored, text_bytes, text_chunks
from suitelens.llm.token_store import checksums, with_end
from suitelens.llm.tokens import encoder

SIZE = 4096
SENTENCE_COST, FREE_COST = 8, 96
RUN_IDS = 1 << 21
PARTITION_BYTES = 24 << 20
_NULL = np.iinfo(np.int64).min
_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, local_sequence long, "
           "offset long")


def padding(length: int, size: int = SIZE) -> int:
    """Ids added to a sequence: it is filled up to ``size`` unless it is a power of two."""
    return 0 if length & (length - 1) == 0 else size - length


def allowed_cuts(ends: np.ndarray, sentences: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, and the penalty of each. ``ends``: document ends,
    the last one the run's; ``sentences``: ends of sentences."""
    total = int(ends[-1])
    places = np.unique(np.concatenate([[0], ends, sentences]))
    gaps = np.flatnonzero(np.diff(places) > size // 4)
    step = size // 4
    inner = [np.arange(places[g] + step, places[g + 1], step) for g in gaps]
    tail = total - (1 << np.arange(size.bit_length()))
    places = np.unique(np.concatenate([places, *inner, tail[tail > 0]]))
    cost = np.full(len(places), FREE_COST, np.int64)
    cost[np.searchsorted(places, sentences)] = SENTENCE_COST
    cost[np.searchsorted(places, ends)] = 0
    return places, cost


def best_cuts(places: np.ndarray, cost: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The cuts, from the first to the last place, of least padding plus penalties."""
    n = len(places)
    exact: dict[int, list[int]] = {}  # place -> places a power of two before it
    last = n - 1
    for k in range(size.bit_length() - 1):
        js = np.arange(1, n) if 1 << k >= size // 8 else np.array([last])
        want = places[js] - (1 << k)
        at = np.searchsorted(places, want)
        for j, i in zip(js[places[at] == want].tolist(), at[places[at] == want].tolist(), strict=True):
            exact.setdefault(j, []).append(i)
    at, pen = places.tolist(), cost.tolist()
    value, source = [0] * n, [0] * n  # value: least cost up to a place, plus the place
    queue, head = [0], 0
    for j in range(1, n):
        here = at[j]
        low = here - size
        while at[queue[head]] < low:
            head += 1
        i = queue[head]
        least = value[i] + size - here
        if j in exact:
            for e in exact[j]:
                if value[e] - at[e] <= least:
                    least, i = value[e] - at[e], e
        v = value[j] = least + pen[j] + here
        source[j] = i
        while len(queue) > head and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts, j = [], last
    while j:
        cuts.append(at[j])
        j = source[j]
    return np.array([0, *reversed(cuts)], np.int64)


def sentence_ends(tokenizer: str) -> np.ndarray:
    """Ids that end a sentence: those whose string holds nothing but ``. ! ?``."""
    with open(tokenizer, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return np.array(sorted(i for w, i in vocab.items() if (s := w.removesuffix("</w>")) and set(s) <= set(".!?") and w != s), np.int64)


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = partitions_for(text_bytes(rows), PARTITION_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sequence = TaskContext.get().partitionId(), 0
        stops = sentence_ends(tokenizer)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        length = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held, length
            docs, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            ends = np.cumsum(counts)
            is_stop = np.zeros(int(max(ids.max(), stops.max(initial=0))) + 1, bool)
            is_stop[stops] = True
            cuts = best_cuts(*allowed_cuts(ends, np.flatnonzero(is_stop[ids]) + 1, size), size)
            begins = np.union1d(cuts[:-1], ends - counts)
            sizes = np.diff(np.append(begins, ends[-1]))
            of = np.searchsorted(ends, begins, "right")
            window = np.searchsorted(cuts, begins, "right") - 1
            out = pa.RecordBatch.from_arrays(
                [pa.array(docs[of], pa.int64(), mask=docs[of] == _NULL), pa.array(begins - (ends - counts)[of]), pa.array(sizes),
                 pa.array(checksums(ids, sizes)), pa.array(counts[of]), pa.array(np.full(len(of), part, np.int64)),
                 pa.array(window + sequence), pa.array(begins - cuts[window])],
                names=[f.split()[0] for f in _PIECES.split(", ")])
            sequence, held, length = sequence + len(cuts) - 1, [], 0
            return out

        for chunk in text_chunks(batches, chunk_bytes=1 << 19):
            ids, counts = with_end(*encoder(tokenizer).encode(chunk.column("text").to_pylist()), end_id)
            held.append((chunk.longs("doc_id"), counts, ids))
            length += len(ids)
            if length >= RUN_IDS:
                yield flush()
        if held:
            yield flush()

    pieces = stored(rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _PIECES), "pieces")
    last = pieces.groupBy("part").agg((F.max("local_sequence") + 1).alias("n"))  # one row per partition
    before = last.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                         .alias("before"))
    return pieces.join(before, "part").select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                              (F.col("before") + F.col("local_sequence")).alias("sequence_id"), "offset")
