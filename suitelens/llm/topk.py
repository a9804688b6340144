"""Exact top-k inner products over norm-sorted vectors.

Vectors are stored by descending length. They are rotated into the basis of the second
moment's singular vectors, where the first coordinates hold most of an inner product. For
a block of queries each task goes through its vectors in steps: it skips a step whose longest
one cannot reach the k-th best score so far (Cauchy-Schwarz on whole vectors); in the others,
it sums the first rotated coordinates and drops pairs whose sum plus the product of the
residual lengths stays below it (Cauchy-Schwarz on residuals). What is left is
scored exactly, in integers. The k-th best starts from the longest vectors of all. The order
makes skips frequent; no result depends on it, as Spark packs files into partitions by size.

Queries are processed in blocks of a bounded number; each block is a scan of the
vectors. A task returns at most k candidates per query, and the best k of those are
taken by a window with a group limit.

Defined cases: vectors that are null or hold null or non-finite components take no part;
shorter vectors count as filled up with zeros; a row is not its own candidate, but a
repeated row is; ties go to the smaller id; fewer candidates than k give fewer rows; an
empty table gives an empty result; extra columns are ignored. Scores are exact while the
product of two lengths stays below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suitelens.llm.common import partitions_for, prepare, stored

#: queries of one block, and longest vectors that give the first bounds
BLOCK_QUERIES, HEAD = 2048, 1024
#: components of one partition of vectors
PARTITION_VALUES = 4 << 20
STEP = 1024  # vectors compared at once
_HIT = "query long, query_id long, row long, vec_id long, score long"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as a float matrix, filled up with zeros."""
    out = np.zeros((len(column), dim))
    n = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    at = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(column)), n), at] = values
    return out


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """``row, vec_id, v`` (floor of ``scale`` times each component), ``norm2`` of valid vectors, stored by length."""
    def finite(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    ok = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e")) \
                .filter(F.col("e").isNotNull() & F.forall("e", finite))
    v = ok.select("vec_id", F.transform("e", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    v = v.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    first = stored(v.withColumn("row", F.monotonically_increasing_id()), "vectors")
    values = int(first.agg(F.sum(F.size("v")).alias("n")).first()["n"] or 0)
    n = max(first.rdd.getNumPartitions(), partitions_for(values, PARTITION_VALUES))
    return stored(first.repartitionByRange(n, F.desc("norm2"), "row").sortWithinPartitions(F.desc("norm2"), "row"), "vectors")


def _rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Singular vectors of the second moment; one matrix per task comes back, one at a time."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in parts:
            x = _matrix(batch.column(0), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["m"])

    total = np.zeros((dim, dim))
    for r in vectors.select("v").mapInArrow(run, "m binary").toLocalIterator():
        total += np.frombuffer(r["m"]).reshape(dim, dim)
    return np.linalg.svd(total)[0]


class Queries:
    """A block of queries with their bounds."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, turn: np.ndarray, k: int, head: tuple[np.ndarray, np.ndarray]):
        self.rows, self.ids, self.v, self.k = rows, ids, v, k
        self.turn, self.cuts = turn, sorted({max(1, turn.shape[0] // 4), max(1, turn.shape[0] // 2)})
        self.turned = v @ turn
        self.rest = {c: np.sqrt((self.turned[:, c:] ** 2).sum(1)) for c in self.cuts}
        self.norm = np.sqrt((v ** 2).sum(1))
        self.bound = np.full(len(rows), -np.inf)
        if len(head[0]) > k:
            scores = v @ head[1].T
            scores[rows[:, None] == head[0][None, :]] = -np.inf
            self.bound = -np.partition(-scores, k - 1, axis=1)[:, k - 1]

    def search(self, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = self.bound.copy()
        best: list[np.ndarray] = [np.zeros((0, 4))]  # query, row, id, score
        held = 0
        for batch in parts:
            rows, ids, norm2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            for a in range(0, len(rows), STEP):
                # a partition may hold several files in any order: longer vectors can follow shorter ones
                q = np.flatnonzero(self.norm * np.sqrt(norm2[a:a + STEP].max()) * (1 + 1e-9) >= bound)
                if not len(q):
                    continue
                part = _matrix(batch.column(2).slice(a, STEP), self.v.shape[1])
                turned = part @ self.turn
                size = np.sqrt(norm2[a:a + STEP])
                alive = self.norm[q][:, None] * size[None, :] * (1 + 1e-9) >= bound[q][:, None]
                for c in self.cuts:
                    sums = self.turned[q, :c] @ turned[:, :c].T + np.outer(self.rest[c][q], np.sqrt((turned[:, c:] ** 2).sum(1)))
                    alive &= sums + 1e-6 * (1 + self.norm[q][:, None] * size[None, :]) >= bound[q][:, None]
                i, j = np.nonzero(alive)
                score = np.einsum("ij,ij->i", self.v[q[i]], part[j]) if len(i) < alive.size // 8 else (self.v[q] @ part.T)[i, j]
                good = (score >= bound[q[i]]) & (self.rows[q[i]] != rows[a + j])
                i, j, score = q[i[good]], a + j[good], score[good]
                if len(i):
                    best.append(np.stack([i, rows[j], ids[j], score], 1).astype(np.int64))
                    held += len(i)
                if held > 4 * self.k * len(self.rows):
                    best, bound = self._cut(best, bound)
                    held = len(best[0])
        yield from self._emit(best)

    def _cut(self, best: list[np.ndarray], bound: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The best k of each query, and bounds that follow from them."""
        hits = np.concatenate(best).astype(np.int64)
        hits = hits[np.lexsort((hits[:, 1], hits[:, 2], -hits[:, 3], hits[:, 0]))]
        first = np.searchsorted(hits[:, 0], hits[:, 0], "left")
        rank = np.arange(len(hits)) - first
        hits = hits[rank < self.k]
        last = hits[rank[rank < self.k] == self.k - 1]
        bound = bound.copy()
        bound[last[:, 0]] = np.maximum(bound[last[:, 0]], last[:, 3])
        return [hits], bound

    def _emit(self, best: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hits = self._cut(best, self.bound)[0][0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(self.rows[hits[:, 0]]), pa.array(self.ids[hits[:, 0]]), *(pa.array(hits[:, c]) for c in (1, 2, 3))],
            names=[f.split()[0] for f in _HIT.split(", ")])


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` largest inner products.
    ``is_query``: a condition on ``vec_id``."""
    spark = vectors.sparkSession
    prepare(spark)
    known = quantised(vectors, vec_id, embedding)
    dim = int(known.agg(F.max(F.size("v")).alias("d")).first()["d"] or 0)
    hits = spark.createDataFrame([], _HIT)
    if dim:
        turn = _rotation(known, dim)

        def arrays(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            v = np.zeros((len(rows), dim))
            for i, r in enumerate(rows):
                v[i, :len(r["v"])] = r["v"]
            return np.array([r["row"] for r in rows], np.int64), np.array([r["vec_id"] for r in rows], np.int64), v

        longest, _, head = arrays([r.asDict() | {"vec_id": 0} for r in known.orderBy(F.desc("norm2"), "row").limit(HEAD).collect()])
        block: list = []
        parts = []

        def search(rows: list) -> None:
            queries = spark.sparkContext.broadcast(Queries(*arrays(rows), turn, k, (longest, head)))
            parts.append(known.select("row", "vec_id", "v", "norm2").mapInArrow(lambda batches: queries.value.search(batches), _HIT))

        for r in known.filter(is_query & F.col("vec_id").isNotNull()).select("row", "vec_id", "v").toLocalIterator():
            block.append(r)
            if len(block) == BLOCK_QUERIES:
                search(block)
                block = []
        if block:
            search(block)
        for p in parts:
            hits = hits.unionByName(p)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return (hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
