"""SRC-3 scan_log_lines: text logs as rows with their file and in-file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_name() -> Column:
    """The file of a row, as it is called (Spark's metadata has it percent-encoded)."""
    # url_decode reads a plus sign as a blank; in a path it is a plus sign
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def scan_log_lines(spark: SparkSession, path: str, glob: str | None = None,
                   recursive: bool = True) -> DataFrame:
    """``file, block, seq, value``: one row per line.

    In-file order is ``(block, seq)``: ``block`` is the byte offset of the split a
    line was read from and ``seq`` increases line by line inside a split. A big log
    is split over several tasks, and splits are not run in offset order, so a
    global id alone would not give file order.
    """
    # only a line feed ends a line, as for grep and awk: progress output may hold bare \\r
    reader = spark.read.format("text").option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    return df.select(
        file_name().alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value")
