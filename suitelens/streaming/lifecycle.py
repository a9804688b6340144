"""Structured Streaming forms of STR-1 (readiness) and STR-2 (job polling).

Each micro-batch is reduced with the batch operators' own partial aggregations (the
earliest event and the earliest terminal one of a resource; the first polls of a job),
which combine map-side, so a key that holds a third of the rows never meets in one task.
The reduction is merged with a keyed state table of undecided keys, and a key is decided
once the watermark has passed the time of its decision: until then an earlier event
may still come. So the result is the batch form's for events in any order within the
watermark's delay. Decided keys stay in the result table, and their later events are
tested against it; a key is decided once.

State, results and the largest time seen are tables with one part per micro-batch
(``runner.BatchTable``); a batch reads the state and the time of the one before, and the results in a few
merged parts. All times are epoch microseconds computed by Spark.

With a ``root`` of the caller's, a stream that failed, or one to which more has come, goes on
where it stopped when it is called again: Spark's checkpoint knows what was read, and a batch that was not finished is
run again over the same tables. What one call decided is part of the result of the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from suitelens.operators.lifecycle import (ACTIVE, DONE, ERROR, FAIL, FAILED, MAX_POLLS, READY,
                                           READY_TIMEOUT_S, SUCCESS, TIMED_OUT)
from suitelens.streaming.runner import BatchTable, run_batches, stream_root

READINESS_OUT = "resource long, first_us long, state string, decided_us long"
READINESS_STATE = "resource long, first_us long, terminal struct<ts_us: long, tiebreak: long, status: string>"
JOBS_OUT = "job_id long, state string, decided_poll long, fail_reason string"
JOBS_STATE = "job_id long, ts_us long, tiebreak long, status string, fail_reason string"
CLOCK = "max_us long"


def _delay_us(spark: SparkSession, delay: str) -> int:
    """An interval such as ``1 hour`` in microseconds."""
    zero = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    return spark.sql(f"SELECT unix_micros(CAST({zero} + INTERVAL {delay} AS TIMESTAMP)) - unix_micros(CAST({zero} AS TIMESTAMP)) AS us").first()["us"]


class _Keyed:
    """State, results and clock of a keyed stream."""

    def __init__(self, spark: SparkSession, name: str, key: str, state: str, out: str, delay: str, root: str | None):
        self.root, self.key, self.delay_us = stream_root(spark, name, root), key, _delay_us(spark, delay)
        self.state, self.out, self.clock = (BatchTable(f"{self.root}/{t}", s) for t, s in (("state", state), ("out", out), ("clock", CLOCK)))
        self.fresh = BatchTable(f"{self.root}/fresh", state)

    def merge(self, rows: DataFrame, reduce, batch: int, ts_us: str = "ts_us") -> tuple[DataFrame, Column]:
        """Undecided keys with this batch's rows, reduced; and the watermark. Rows behind the
        watermark of the batches before, and of decided keys, are left out."""
        spark = rows.sparkSession
        before = self.clock.read(spark, batch - 1).first()
        seen = before["max_us"] if before else None
        if seen is not None:
            rows = rows.where(F.col(ts_us) >= seen - self.delay_us)
        self.clock.write(rows.agg(F.greatest(F.max(ts_us), F.lit(seen).cast("long")).alias("max_us")), batch)
        now = self.clock.read(spark, batch).first()["max_us"]
        decided = self.out.upto(spark, batch - 1).select(self.key)
        self.fresh.write(reduce(rows), batch)
        fresh = self.fresh.read(spark, batch).join(decided, self.key, "left_anti")
        held = self.state.read(spark, batch - 1).unionByName(fresh)
        watermark = F.lit(None).cast("long") if now is None else F.lit(now - self.delay_us)
        return held, watermark

    def publish(self, kept: DataFrame, decided: DataFrame, batch: int) -> None:
        self.out.write(decided, batch)
        self.state.write(kept, batch)
        self.out.merge(kept.sparkSession, batch)


def track_readiness_stream(events: DataFrame, resource: str, ts: str, status: str, tiebreak: str,
                           timeout_s: int = READY_TIMEOUT_S, delay: str = "1 hour", name: str = "readiness-stream",
                           run_timeout_s: float | None = None, root: str | None = None) -> DataFrame:
    """STR-1 on a stream, run over all that is available: ``resource, first_seen, state,
    decided_at``. A resource comes out once the watermark (largest ``ts`` less ``delay``)
    passes its decision: its first terminal status, or first_seen + timeout."""
    spark = events.sparkSession
    keyed = _Keyed(spark, name, "resource", READINESS_STATE, READINESS_OUT, delay, root)
    src = events.select(F.col(resource).cast("long").alias("resource"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts_us"),
                        F.col(status).alias("status"), F.col(tiebreak).cast("long").alias("tiebreak"))
    terminal = F.when(F.col("status").isin(ACTIVE, ERROR), F.struct("ts_us", "tiebreak", "status"))
    timeout_us = int(timeout_s) * 1_000_000

    def step(rows: DataFrame, batch: int) -> None:
        held, watermark = keyed.merge(
            rows, lambda r: r.groupBy("resource").agg(F.min("ts_us").alias("first_us"), F.min(terminal).alias("terminal")), batch)
        one = held.groupBy("resource").agg(F.min("first_us").alias("first_us"), F.min("terminal").alias("terminal"))
        deadline = F.col("first_us") + timeout_us
        in_time = F.coalesce(F.col("terminal.ts_us") < deadline, F.lit(False))
        at = F.when(in_time, F.col("terminal.ts_us")).otherwise(deadline)
        state = F.when(~in_time, F.lit(TIMED_OUT)).when(F.col("terminal.status") == ACTIVE, F.lit(READY)).otherwise(F.lit(FAILED))
        over = F.coalesce(at < watermark, F.lit(False))
        keyed.publish(one.where(~over), one.where(over).select("resource", "first_us", state.alias("state"), at.alias("decided_us")), batch)

    last = run_batches(src, spark, name, step, keyed.root, run_timeout_s)
    return keyed.out.upto(spark, last).select("resource", F.timestamp_micros("first_us").alias("first_seen"), "state",
                                       F.timestamp_micros("decided_us").alias("decided_at"))


def track_jobs_stream(polls: DataFrame, job: str, ts: str, status: str, reason: str, tiebreak: str,
                      max_polls: int = MAX_POLLS, delay: str = "1 hour", name: str = "jobs-stream",
                      run_timeout_s: float | None = None, root: str | None = None) -> DataFrame:
    """STR-2 on a stream, run over all that is available: ``job_id, state, decided_poll,
    fail_reason``. State is a job's first ``max_polls`` polls by time; the job is decided at
    SUCCESS, FAIL or poll ``max_polls`` once the watermark passes that poll."""
    spark = polls.sparkSession
    keyed = _Keyed(spark, name, "job_id", JOBS_STATE, JOBS_OUT, delay, root)
    src = polls.select(F.col(job).cast("long").alias("job_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts_us"),
                       F.col(tiebreak).cast("long").alias("tiebreak"), F.col(status).alias("status"), F.col(reason).alias("fail_reason"))
    order = Window.partitionBy("job_id").orderBy("ts_us", "tiebreak")

    def first(rows: DataFrame) -> DataFrame:  # a window group limit: each task sends at most max_polls rows of a job
        return rows.withColumn("poll", F.row_number().over(order).cast("long")).where(F.col("poll") <= max_polls)

    def step(rows: DataFrame, batch: int) -> None:
        held, watermark = keyed.merge(rows, lambda r: first(r).drop("poll"), batch)
        polls_ = first(held)
        ends = F.when(F.col("status").isin(SUCCESS, FAIL) | (F.col("poll") >= max_polls),
                      F.struct("poll", "ts_us", "status", "fail_reason"))
        one = polls_.groupBy("job_id").agg(F.min(ends).alias("end"))
        done = one.where(F.col("end.ts_us") < watermark).select(
            "job_id", F.when(F.col("end.status") == SUCCESS, F.lit(DONE)).when(F.col("end.status") == FAIL, F.lit(FAILED))
            .otherwise(F.lit(TIMED_OUT)).alias("state"), F.col("end.poll").alias("decided_poll"),
            F.when(F.col("end.status") == FAIL, F.col("end.fail_reason")).alias("fail_reason"))
        keyed.publish(polls_.drop("poll").join(done.select("job_id"), "job_id", "left_anti"), done, batch)

    last = run_batches(src, spark, name, step, keyed.root, run_timeout_s)
    return keyed.out.upto(spark, last)
