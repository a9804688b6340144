"""Token-id output: texts to ids, coded with Simple-8b, in files in ascending id order.

Documents are range-partitioned by id; each task encodes its range and writes blocks
of whole documents (about ``BLOCK_IDS`` ids; a longer document is a block of its own).
A block's payload is binary and describes itself: header, document ids, ids per
document, lane offsets, 64-bit words. Blocks are rows of Parquet files, so that Spark's
commit publishes whole files only and any store that Spark reaches will do.

Reading decodes blocks independently of each other. Where a document starts in the
whole stream is the sum of the partitions before its own plus its place in there; only
one number per partition is summed up.

Defined cases: a null text has the end id only; a null document id sorts first; rows
with one id follow each other by text; an empty table writes no block; extra columns
are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from suitelens.llm import simple8b
from suitelens.llm.common import partitions_for, prepare, text_bytes, text_chunks
from suitelens.llm.tokens import encoder

BLOCK_IDS = 1 << 17
#: text of one output partition
PARTITION_BYTES = 24 << 20
#: partitions of the files (16 bytes each) whose places are broadcast; more are joined by shuffle
BROADCAST_PARTS = 1 << 20
_MAGIC = b"S8B1"
_NULL = np.iinfo(np.int64).min
_FILE = "part long, block long, part_start long, n_docs long, n_ids long, payload binary"


def pack_block(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, lanes = simple8b.encode(ids)
    head = _MAGIC + struct.pack("<IQII", len(doc_ids), len(ids), len(lanes), len(words))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes(),
                     lanes.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def unpack_block(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, ids of each document, and all ids."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a token block")
    n_docs, n_ids, n_lanes, n_words = struct.unpack_from("<IQII", payload, 4)
    at = 4 + struct.calcsize("<IQII")
    doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
    counts = np.frombuffer(payload, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    lanes = np.frombuffer(payload, "<u4", n_lanes, at + 16 * n_docs)
    words = np.frombuffer(payload, "<u8", n_words, at + 16 * n_docs + 4 * n_lanes)
    return doc_ids, counts, simple8b.decode(words, lanes, n_ids)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all ``docs`` below ``path``."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = partitions_for(text_bytes(rows), PARTITION_BYTES)
    out_type = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("part_start", pa.int64()), ("n_docs", pa.int64()),
                          ("n_ids", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held, size
            doc_ids, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = (part, block, start, len(doc_ids), len(ids), pack_block(doc_ids, counts, ids))
            block, start, held, size = block + 1, start + len(ids), [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out_type, strict=True)], schema=out_type)

        for chunk in text_chunks(batches, chunk_bytes=1 << 19):
            ids, counts = with_end(*encoder(tokenizer).encode(chunk.column("text").to_pylist()), end_id)
            held.append((chunk.longs("doc_id"), counts, ids))
            size += len(ids)
            if size >= BLOCK_IDS:
                yield flush()
        if held:
            yield flush()

    (rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, _FILE).write.option("compression", "uncompressed").parquet(path))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each document."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def map_documents(spark: SparkSession, path: str, function: Callable[[np.ndarray, np.ndarray], list], schema: T.StructType) -> DataFrame:
    """Decode the files and call ``function(ids, counts)`` per block; it returns the
    columns of ``schema``, one value per document. Result: ``doc_id, start, n_tokens`` and these."""
    files = spark.read.schema(_FILE).parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per partition of the files
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                         .alias("before"))
    if sums.count() <= BROADCAST_PARTS:  # the blocks themselves then stay where they are read
        before = F.broadcast(before)
    mine = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                doc_ids, counts, ids = unpack_block(r["payload"])
                start = r["before"] + r["part_start"] + np.cumsum(counts) - counts
                columns = function(ids, counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64(), mask=doc_ids == _NULL), pa.array(start), pa.array(counts), *columns],
                    names=[f.name for f in [*mine, *schema]])

    return (files.join(before, "part").select("before", "part_start", "payload")
            .mapInArrow(run, T.StructType([*mine.fields, *schema.fields])))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files."""
    def arrays(ids, counts):
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int64)))]
    return map_documents(spark, path, arrays, T.StructType([T.StructField("ids", T.ArrayType(T.LongType()))]))


def checksums(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each run of ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(ids.astype("<u4").tobytes())
    ends = np.cumsum(counts) * 4
    return np.array([zlib.crc32(raw[a:b]) for a, b in zip((ends - counts * 4).tolist(), ends.tolist(), strict=True)], np.int64)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""
    return map_documents(spark, path, lambda ids, counts: [pa.array(checksums(ids, counts), pa.int64())],
                         T.StructType([T.StructField("ids_crc32", T.LongType())]))
