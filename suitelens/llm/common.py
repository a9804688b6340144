"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suitelens.session import new_shared_dir, ship_package, table

__all__ = ["prepare", "stored", "table", "text_bytes", "partitions_for", "text_chunks", "TextChunk", "small_enough",
           "tokenizer_path", "END_ID"]

#: Text of one numpy step inside a task; a longer document is a step of its own.
CHUNK_BYTES = 2 << 20
#: Text that crosses to a Python worker at once.
ARROW_BYTES = 4 << 20


#: the id that ends a document in token streams
END_ID = 2


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def prepare(spark: SparkSession) -> None:
    """Make this package importable on the executors and bound Arrow batches by bytes
    (a batch of long documents must not fill a worker)."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, so
    a lost executor costs re-reading a file and not a recomputation."""
    path = new_shared_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts (one partial aggregation)."""
    return int(docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0)


def partitions_for(n_bytes: int, per_partition: int) -> int:
    """Number of partitions that keeps each at about ``per_partition`` bytes."""
    return max(1, -(-n_bytes // per_partition))


def small_enough(df: DataFrame, column: str, max_bytes: int) -> bool:
    """Whether the binary ``column`` of all rows together stays within ``max_bytes``."""
    return int(df.agg(F.sum(F.octet_length(column)).alias("b")).first()["b"] or 0) <= max_bytes


class TextChunk:
    """Some documents of an Arrow batch as one byte array: document i is
    ``data[begin[i]:end[i]]``; documents follow each other without a gap."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data = rows, data
        self.begin, self.end = offsets[:-1], offsets[1:]

    def __len__(self) -> int:
        return len(self.begin)

    def column(self, name: str) -> pa.Array:
        return self.rows.column(self.rows.schema.get_field_index(name))

    def longs(self, name: str) -> np.ndarray:
        """A long column; null is the smallest long, so it sorts first."""
        return self.column(name).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text",
                chunk_bytes: int = CHUNK_BYTES) -> Iterator[TextChunk]:
    """Cut Arrow batches into chunks of about ``chunk_bytes`` of text, without copying
    it. A null text is an empty one; a longer document makes a chunk of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)
        offsets = offsets[col.offset:col.offset + len(col) + 1].astype(np.int64)
        raw = col.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(col):
            j = int(np.searchsorted(offsets, offsets[i] + chunk_bytes, "right")) - 1
            j = min(max(j, i + 1), len(col))
            yield TextChunk(batch.slice(i, j - i), data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            i = j
