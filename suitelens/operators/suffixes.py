"""Which texts end with any of a set of endings, as one sorted pass.

Texts and endings are written backwards and sorted together, so that "ends with" becomes
"begins with", and an ending stands before the texts that have it. Of the endings that no other
ending is the end of, the last one up to a text is the only one that the text can have: what
lies between a text and a beginning of it has that beginning too. So one ending is carried along the order, and
neither the number of endings nor their lengths multiply a text.

Rows are range-partitioned; a partition starts with nothing carried, is written once, and is then given
what the partitions before it carry, a row per partition, found by the same walk over their last endings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suitelens.operators.ranking import ranged_rows
from suitelens.session import new_shared_dir


def carried(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """For endings written backwards, in order (null: a text), the shortest one that the place's ending begins
    with; at a text, the one of the last ending before."""
    held = None
    for backwards in frames:
        out = []
        for ending in backwards:
            if ending is not None and (held is None or not ending.startswith(held)):
                held = ending
            out.append(held)
        yield pd.Series(out, dtype=object)


def _carried(ending: Column) -> Column:
    @F.pandas_udf("string")
    def walk(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return carried(frames)

    return walk.asNondeterministic()(ending)


def ends_with_any(texts: DataFrame, endings: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """``text``: the distinct values of the one column of ``texts`` that end with a value of the one column of
    ``endings``. Nulls end with nothing and are no endings; every text ends with an empty one."""
    spark = texts.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (text,), (ending,) = texts.columns, endings.columns
    rows = (texts.select(F.reverse(text).alias("_back"), F.lit(False).alias("_ending"))
            .unionByName(endings.select(F.reverse(ending).alias("_back"), F.lit(True).alias("_ending")))
            .where(F.col("_back").isNotNull()).distinct())
    ranged = ranged_rows(rows, [F.col("_back"), F.col("_ending").desc()], n)
    walked = ranged.withColumn("_held", _carried(F.when(F.col("_ending"), F.col("_back"))))
    path = new_shared_dir(spark, "endings")
    walked.write.parquet(path)
    walked = spark.read.schema(walked.schema).parquet(path)

    # one row per partition: what it holds at its end, and then what all up to it hold
    ends = walked.groupBy("_pid").agg(F.max_by("_held", "_mid").alias("_end")).coalesce(1).sortWithinPartitions("_pid")
    so_far = ends.select("_pid", _carried(F.col("_end")).alias("_state"))
    before = so_far.select(F.col("_pid").alias("_cpid"), F.lag("_state").over(Window.orderBy("_pid")).alias("_carry"))
    found = walked.where(~F.col("_ending")).join(F.broadcast(before), F.col("_pid") == F.col("_cpid"))
    begins = F.coalesce(F.startswith("_back", F.col("_held")), F.lit(False)) | F.coalesce(F.startswith("_back", F.col("_carry")), F.lit(False))
    return found.where(begins).select(F.reverse("_back").alias("text"))
