"""Run a streaming query to completion into tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from suitelens.session import new_shared_dir


def _start_and_wait(writer: DataStreamWriter, name: str, timeout_s: float | None) -> None:
    """Start ``writer`` and wait until the ``availableNow`` trigger has processed everything
    (for ever by default; a stream over a long history takes as long as it takes)."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError(f"stream {name} did not finish in {timeout_s}s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stream_root(spark: SparkSession, name: str, root: str | None) -> str:
    """Where a stream keeps its progress and tables: the caller's ``root``, from which a later call goes on, or a
    new folder, which no later call finds."""
    return root.rstrip("/") if root else new_shared_dir(spark, name)


def run_available_now(stream: DataFrame, spark: SparkSession, name: str, timeout_s: float | None = None, root: str | None = None) -> DataFrame:
    """Process everything available with a checkpoint and an exactly-once parquet file
    sink (append mode), then return the sink as a batch DataFrame.

    Sink and checkpoint live below ``root``: a call with the same ``root``, after a failure or when more has arrived,
    goes on where the last one stopped. Without it they live in a new folder of the cluster's shared one, and
    a call starts anew.
    """
    root = stream_root(spark, name, root)
    sink, ckpt = f"{root}/out", f"{root}/checkpoint"
    writer = (stream.writeStream.format("parquet").option("path", sink)
              .option("checkpointLocation", ckpt).outputMode("append"))
    _start_and_wait(writer, name, timeout_s)
    return spark.read.schema(stream.schema).parquet(sink)


class BatchTable:
    """A table below ``root`` made of one part per micro-batch, merged in tiers.

    A batch overwrites its own parts only, so a replay after a failure gives the same
    table, and readers never see a gap. After every ``MERGE`` batches their parts are written together as one part
    of the next level, after ``MERGE`` of those one of the level above, and so on: the rows up to a batch are
    in at most ``MERGE`` parts of each level, whose names follow from the batch's number, and a row is written once per
    level. ``reduce`` may shrink what is merged (rows that add up).
    """

    MERGE = 32

    def __init__(self, root: str, schema: str, reduce: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.root, self.schema, self.reduce = root, schema, reduce

    def _path(self, level: int, batch: int) -> str:
        return f"{self.root}/level={level}/batch={batch}"

    def _cover(self, batch: int) -> list[tuple[int, int]]:
        """Parts (level, last batch) that together hold batches 0 to ``batch``."""
        out, done, size, level = [], 0, 1, 0
        while size * self.MERGE <= batch + 1:
            size, level = size * self.MERGE, level + 1
        while level >= 0:
            while done + size <= batch + 1:
                done += size
                out.append((level, done - 1))
            size, level = size // self.MERGE, level - 1
        return out

    def _read(self, spark: SparkSession, parts: list[tuple[int, int]]) -> DataFrame:
        if not parts:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[self._path(*p) for p in parts])

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(self._path(0, batch))

    def merge(self, spark: SparkSession, batch: int) -> None:
        """The merged parts that end with this batch."""
        size, level = self.MERGE, 1
        while (batch + 1) % size == 0:
            step = size // self.MERGE
            parts = [(level - 1, batch - step * k) for k in range(self.MERGE)]
            self.reduce(self._read(spark, parts)).write.mode("overwrite").parquet(self._path(level, batch))
            size, level = size * self.MERGE, level + 1

    def read(self, spark: SparkSession, batch: int) -> DataFrame:
        """The rows of one batch (none before the first)."""
        return self._read(spark, [(0, batch)] if batch >= 0 else [])

    def upto(self, spark: SparkSession, batch: int) -> DataFrame:
        """The rows of all batches up to this one."""
        return self._read(spark, self._cover(batch))


def last_batch(spark: SparkSession, root: str) -> int:
    """The last micro-batch that the stream with its progress below ``root`` has finished; -1 if none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/checkpoint/commits")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return -1
    names = [f.getPath().getName() for f in store.listStatus(path)]  # Spark keeps the last hundred or so
    return max([int(n) for n in names if n.isdigit()], default=-1)


def run_batches(stream: DataFrame, spark: SparkSession, name: str, step: Callable[[DataFrame, int], None], root: str,
                timeout_s: float | None = None) -> int:
    """Call ``step(rows, batch id)`` for each micro-batch; progress is kept below ``root``, and batches that an
    earlier call finished are not run again. Returns the last finished batch."""
    writer = (stream.writeStream.outputMode("append").foreachBatch(step)
              .option("checkpointLocation", f"{root}/checkpoint"))
    _start_and_wait(writer, name, timeout_s)
    return last_batch(spark, root)
