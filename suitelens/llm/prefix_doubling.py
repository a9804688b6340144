"""Substring dedup over bytes by anchors, with one doubling step inside a bucket.

Removes every byte covered by a string of ``width`` bytes that also starts in a
document of a smaller id. ``dedup_substrings`` matches strings at growing
lengths, and only those that others share go on (``repeated_strings`` ranks all positions by Spark sorts):

* length ``gram``: the anchors of all windows (see ``repeats``) are matched across the whole
  corpus by a shuffle on their 64-bit names; unique ones leave;
* then, in the shuffle by anchor, windows are numbered by the name of their first half, and
  those that share it by the pair ``(number of s, number of s + half)``; windows of heavy
  anchors meet by their own 64-bit names instead.

Defined cases: a null or empty text has no bytes; a text shorter than ``width`` keeps
all; of repeated rows with one id none counts as smaller; a null id is smaller than all;
an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from suitelens.llm.common import prepare, stored
from suitelens.llm.repeats import ADDED, Symbols, remove_repeats, window_names_sliced

WIDTH, GRAM = 50, 20


def rank_windows(names: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Ranks of the strings of ``width`` symbols at ``starts``: equal strings, equal ranks.
    Names are doubled up to half the width; then positions are sorted by the rank of their
    first half, those that share it with others by the pair with the second half's."""
    half = -(-width // 2)
    halves = window_names_sliced(names, half)
    _, rank, n = np.unique(halves[starts], return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n[rank] > 1)  # the others are unique already
    if half == width or not len(shared):
        return rank
    second = np.unique(halves[starts[shared] + width - half], return_inverse=True)[1]
    pair = rank[shared] * (int(second.max()) + 1) + second
    rank[shared] = len(n) + np.unique(pair, return_inverse=True)[1]
    return rank


def dedup_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text",
                     whole_characters: bool = False) -> DataFrame:
    """``docs`` (without ``text``) with ``n_symbols, n_removed, spans, kept``; see ``repeats.remove_repeats``."""
    def compare(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return rank_windows(names, starts, width)
    return remove_repeats(docs, Symbols(words=False, width=width, gram=gram, strict=True), compare, doc_id, text, whole_characters)


_RANKED = "id long, doc long, start long, rank long, many boolean"


def _positions(parts: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """A row for each place of a text with its first bytes as a number."""
    for part in parts:
        for doc, own, text in zip(*(part.column(c).to_pylist() for c in ("id", "doc", "text")), strict=True):
            data = np.frombuffer((text or "").encode("utf-8"), np.uint8)
            n = max(0, len(data) - first + 1)
            for a in range(0, n, 1 << 18):
                m = min(n, a + (1 << 18)) - a
                rank = np.zeros(m, np.uint64)
                for k in range(first):
                    rank = (rank << np.uint64(8)) | data[a + k:a + k + m]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, own), pa.int64()), pa.array([doc] * m, pa.int64()),
                                                  pa.array(np.arange(a, a + m)), pa.array(rank.view(np.int64))], names=["doc", "id", "start", "r1"])


def _rerank(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with equal ``r1, r2`` get the number of their first one; ``many``: not the only one. A row
    is kept back until the next one is seen."""
    from pyspark import TaskContext

    high, seen, held = TaskContext.get().partitionId() << 40, 0, None
    names = [f.split()[0] for f in _RANKED.split(", ")]

    def batch(ids, doc, start, rank, many):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()),
                                           pa.array(rank, pa.int64()), pa.array(many, pa.bool_())], names=names)

    for part in parts:
        if not part.num_rows:
            continue
        ids, doc, start, r1, r2 = (part.column(c).to_pylist() if c == "id" else part.column(c).to_numpy() for c in ("id", "doc", "start", "r1", "r2"))
        same = np.append(False, (r1[1:] == r1[:-1]) & (r2[1:] == r2[:-1]))
        if held is not None:
            same[0] = (r1[0], r2[0]) == held[5]
        index = np.arange(len(r1))
        rank = high + seen + np.maximum.accumulate(np.where(same, -1, index))
        if same[0]:
            rank[:np.flatnonzero(~same)[0] if (~same).any() else len(rank)] = held[3]
        many = same | np.append(same[1:], False)
        if held is not None:
            yield batch([held[0]], [held[1]], [held[2]], [held[3]], [held[4] or bool(same[0])])
        yield batch(ids[:-1], doc[:-1], start[:-1], rank[:-1], many[:-1])
        held = (ids[-1], doc[-1], start[-1], int(rank[-1]), bool(many[-1]), (r1[-1], r2[-1]))
        seen += len(r1)
    if held is not None:
        yield batch([held[0]], [held[1]], [held[2]], [held[3]], [held[4]])


def repeated_strings(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text", first: int = 8) -> DataFrame:
    """``doc_id, start, rank`` of every string of ``width`` bytes that stands at several places (of one document
    or more); equal strings have equal ranks. This is prefix doubling as Spark sorts: places with the rank of their
    first 8 bytes are joined with the rank at an offset, pairs are range-sorted and ranked anew at 16, 32, ...
    bytes up to ``width``, and only places whose pair others have go on.

    It moves a row for each byte several times (README has figures), which is why ``dedup_substrings`` matches anchors
    instead. Defined cases as there; rows of one id are told apart; equal strings are sorted by one task,
    which streams them.
    """
    spark = docs.sparkSession
    prepare(spark)
    first = min(first, width)
    numbered = stored(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("doc")), "texts")
    rows = numbered.mapInArrow(partial(_positions, first=first), "doc long, id long, start long, r1 long").withColumn("r2", F.lit(0).cast("long"))
    length = first
    while True:
        ranked = rows.repartitionByRange("r1", "r2").sortWithinPartitions("r1", "r2").mapInArrow(_rerank, _RANKED)
        ranked = stored(ranked.filter("many").drop("many"), "ranks")
        if length == width:
            return ranked.select(F.col("id").alias(doc_id), "start", "rank")
        offset = min(length, width - length)
        behind = ranked.select("doc", (F.col("start") - offset).alias("start"), F.col("rank").alias("r2"))
        rows = ranked.withColumnRenamed("rank", "r1").join(behind, ["doc", "start"]).select("doc", "id", "start", "r1", "r2")
        length += offset


def dedup_texts(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text",
                n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with the same columns and the shortened texts; a character stays whole if
    any of its bytes does, and ``n_chars``, if there is one, is counted anew."""
    added = {f.name for f in T._parse_datatype_string(ADDED)}
    aside = {c: f"_own_{c}" if c in added and c not in (doc_id, text) else c for c in docs.columns}
    marked = docs.select(*[F.col(c).alias(a) for c, a in aside.items()], F.col(text).isNull().alias("_no_text"))
    out = dedup_substrings(marked, width, gram, doc_id, text, whole_characters=True)
    out = out.withColumn("_text", F.when(~F.col("_no_text"), F.col("kept").cast("string")))
    kept = out.select(*[F.col("_text" if c == text else a).alias(c) for c, a in aside.items()])
    if n_chars in docs.columns:
        kept = kept.withColumn(n_chars, F.when(F.col(text).isNull(), F.col(n_chars)).otherwise(F.length(text))
                               .cast(docs.schema[n_chars].dataType))
    return kept
