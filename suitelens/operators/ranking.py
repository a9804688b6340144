"""Skew-safe per-group numbering.

``Window.partitionBy(key)`` sends every row of a key to one task; one key may
hold a third of all rows. ``grouped_row_number`` numbers rows within each key
without that: rows are range-partitioned on (keys, order), so a hot key is split
over many partitions, and lie there in order. Only the first key of a partition can have
begun in an earlier one. So a row's number is its place among its key's rows in its
partition, plus, for the partition's first key, a *carry*: how many rows of that key
earlier partitions hold. There is one carry per partition (a segmented prefix sum over the
partitions), whatever the number of keys; rows cross one exchange.

The place within the partition is counted over Arrow batches of one flag per row ("the key is
another one than before"), since a Spark window would shuffle again; the rows themselves
stay in the JVM. The numbered rows are written once to the shared folder, and the carries
come from there. Deriving both from the same plan instead would run two range exchanges, each
with boundaries sampled from its own (pruned) input, and the carries would not fit the rows.

Top-k per group (``rn <= k``) should instead use a plain window with a filter:
Spark plans a ``WindowGroupLimit`` that keeps k rows per key on the map side, so a
hot key sends at most k rows per map task through the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_shared_dir

_PID_SHIFT = 33  # monotonically_increasing_id: partition id in the upper 31 bits


def ranged_rows(df: DataFrame, sort_cols: list, n: int) -> DataFrame:
    """Rows in ``n`` ranges of ``sort_cols``, in order, with a position and its range's number."""
    out = df.repartitionByRange(n, *sort_cols).sortWithinPartitions(*sort_cols).withColumn("_mid", F.monotonically_increasing_id())
    return out.withColumn("_pid", F.shiftright(F.col("_mid"), _PID_SHIFT))


def places(keys: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    """From 1, the place of each row in the run of rows with its key; batches of one partition in order."""
    last, run = None, 0  # the last key, and how many of its rows have been seen
    for frame in keys:
        if not len(frame):
            yield pd.Series([], dtype="int64")
            continue
        new = np.zeros(len(frame), bool)
        for c in frame.columns:  # null is a key like others
            v = frame[c]
            same = (v == v.shift(1)) | (v.isna() & v.shift(1).isna())
            new |= ~same.to_numpy(dtype=bool, na_value=False)
        first = tuple(None if pd.isna(x) else x for x in frame.iloc[0])
        new[0] = first != last
        at = np.arange(len(frame))
        start = np.maximum.accumulate(np.where(new, at, 0))
        place = at - start + 1
        if not new[0]:  # the run that was open goes on until the first new key
            place[:int(np.argmax(new)) if new.any() else len(new)] += run
        last, run = tuple(None if pd.isna(x) else x for x in frame.iloc[-1]), int(place[-1])
        yield pd.Series(place.astype("int64"))


def _place(keys: list[str]) -> Column:
    @F.pandas_udf("long")
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        return places(frames)

    return place.asNondeterministic()(F.struct(*[F.col(k) for k in keys]))


def _carries(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """``_cpid, _carry`` of the partitions whose first key begins earlier, and that key (``_c0, ...``)."""
    key = F.struct(F.lit(True).alias("_"), *keys)
    start = F.shiftleft(F.col("_pid"), _PID_SHIFT)
    first = numbered.where(F.col("_mid") == start).select("_pid", key.alias("first"))
    end = numbered.groupBy("_pid").agg(F.max("_mid").alias("_end")).select("_end")  # one number per partition
    last = numbered.join(F.broadcast(end), F.col("_mid") == F.col("_end")).select(
        F.col("_pid").alias("_lpid"), key.alias("last"), F.col("_place").alias("n"), (F.col("_place") == F.col("_mid") - start + 1).alias("whole"))
    ends = first.join(F.broadcast(last), F.col("_pid") == F.col("_lpid"))
    order = Window.orderBy("_pid")  # over one row per partition
    goes_on = F.lag("last").over(order).eqNullSafe(F.col("first"))
    # a partition's carry is what the one before holds of the key, plus that one's carry if it holds nothing else
    more = F.when(goes_on, F.lag("n").over(order)).otherwise(F.lit(0))
    anew = ~(goes_on & F.coalesce(F.lag("whole").over(order), F.lit(False)))
    steps = ends.select("_pid", "first", more.alias("more"), anew.cast("int").alias("anew"))
    so_far = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("stretch", F.sum("anew").over(so_far))
    within = Window.partitionBy("stretch").orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("_carry", F.sum("more").over(within)).where("_carry > 0").select(
        F.col("_pid").alias("_cpid"), "_carry", *[F.col("first")[k].alias(f"_c{i}") for i, k in enumerate(keys)])


def grouped_row_number(df: DataFrame, keys: list[str], order: list, out: str = "rn",
                       num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based row number within ``keys`` ordered by ``order``.

    ``order`` must make rows unique inside a key (add a unique id as last column)
    so the numbering is deterministic across task retries.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    sort_cols = [F.col(k) for k in keys] + order_cols
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = ranged_rows(df, sort_cols, n).withColumn("_place", _place(keys) if keys else F.col("_mid") - F.shiftleft("_pid", _PID_SHIFT) + 1)
    path = new_shared_dir(df.sparkSession, "numbering")
    numbered.write.parquet(path)
    numbered = df.sparkSession.read.schema(numbered.schema).parquet(path)
    carries = _carries(numbered, keys)
    same = F.col("_pid") == F.col("_cpid")
    for i, k in enumerate(keys):
        same = same & numbered[k].eqNullSafe(F.col(f"_c{i}"))
    joined = numbered.join(F.broadcast(carries), same, "left")  # at most one row per partition
    return joined.withColumn(out, F.col("_place") + F.coalesce("_carry", F.lit(0))) \
        .drop("_mid", "_pid", "_place", "_cpid", "_carry", *[f"_c{i}" for i in range(len(keys))])
