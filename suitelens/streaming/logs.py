"""STR-3: counter extraction over log files as they arrive: per-line rows (stateless)
and per-log totals kept current (only what changed is written per micro-batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suitelens.operators.logs import COUNTERS, extract_log_counters, log_counter_totals
from suitelens.sources.logs import file_name
from suitelens.streaming.runner import BatchTable, run_batches, stream_root

TOTALS = "log string, n_counter_lines long, n_unparsed long, " + ", ".join(f"{c} long" for c in COUNTERS)


def stream_log_counters(spark: SparkSession, path: str, max_files_per_trigger: int | None = None
                        ) -> DataFrame:
    """``file, value, succeeded..pending`` for every ``Tests:`` line of newly arrived files.

    ``path`` may be a glob (e.g. ``root/*/*.txt``). Same projection as the batch
    operator, so the report table can be kept current with an append-only sink.
    """
    reader = spark.readStream.format("text").option("lineSep", "\n")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(path).select(file_name().alias("file"), "value")
    return extract_log_counters(lines)


def _added(parts: DataFrame) -> DataFrame:
    return parts.groupBy("log").agg(*[F.sum(c).alias(c) for c in ("n_counter_lines", "n_unparsed", *COUNTERS)])


class LogTotals:
    """Per-log totals as parts that add up: one part per micro-batch with the logs that it
    changed, merged in tiers (``BatchTable``)."""

    def __init__(self, root: str):
        self.parts = BatchTable(f"{root}/parts", TOTALS, _added)

    def read(self, spark: SparkSession, upto: int) -> DataFrame:
        """The totals of all batches up to one."""
        return _added(self.parts.upto(spark, upto))

    def add(self, rows: DataFrame, batch: int) -> None:
        self.parts.write(log_counter_totals(rows, key="log"), batch)
        self.parts.merge(rows.sparkSession, batch)


def run_log_totals(stream: DataFrame, spark: SparkSession, name: str, log: Column | None = None,
                   timeout_s: float | None = None, root: str | None = None) -> DataFrame:
    """Per-log counter totals kept current as log files arrive, run over all that is
    available. ``log`` derives the log's name from ``file``; by default that is the log. With the same
    ``root`` a later call reads only files that no earlier one has, and gives the totals of all."""
    root = stream_root(spark, name, root)
    totals = LogTotals(root)
    last = run_batches(stream.withColumn("log", F.col("file") if log is None else log), spark, name, totals.add, root, timeout_s)
    return totals.read(spark, last)
