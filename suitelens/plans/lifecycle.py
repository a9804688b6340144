"""Queries for lifecycle tracking (batch and stream) and the log-counter stream.

Events per user stand for the status history of one resource / job:
purchase = ACTIVE / SUCCESS, error = ERROR / FAIL, anything else is transient.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suitelens.operators import lifecycle as lc
from suitelens.operators import logs
from suitelens.plans.logs import ORACLES as LOG_ORACLES
from suitelens.plans.logs import ORDER_COUNTS_SQL, month_log_lines, write_logs
from suitelens.session import new_shared_dir, table
from suitelens.streaming.lifecycle import track_jobs_stream, track_readiness_stream
from suitelens.streaming.logs import run_log_totals, stream_log_counters
from suitelens.streaming.runner import run_available_now

READY_TIMEOUT_S = 24 * 3600   # events are sparse (about 67 per user over 30 days)
WATERMARK_DELAY = "1 hour"


def _status(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    st = (F.when(F.col("event_type") == "purchase", F.lit(lc.ACTIVE))
          .when(F.col("event_type") == "error", F.lit(lc.ERROR)).otherwise(F.col("event_type")))
    return ev.select("user_id", "event_id", "ts", st.alias("status"))


def _polls(ev: DataFrame) -> DataFrame:
    st = (F.when(F.col("event_type") == "purchase", F.lit(lc.SUCCESS))
          .when(F.col("event_type") == "error", F.lit(lc.FAIL)).otherwise(F.lit("RUNNING")))
    return ev.select("user_id", "event_id", "ts", st.alias("status"),
                     F.when(F.col("event_type") == "error", F.col("props")).alias("fail_reason"))


def _attempts(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    outcome = (F.when(F.col("event_type") == "purchase", F.lit("ok"))
               .when(F.col("event_type") == "signup", F.lit("gone")).otherwise(F.lit("error")))
    return ev.select("user_id", "event_id", "ts", outcome.alias("outcome"))


def bounded_attempts(spark, sf_dir):
    return lc.bounded_attempts(_attempts(spark, sf_dir), "user_id", ["ts", "event_id"])


def bounded_attempts_strict(spark, sf_dir):
    return lc.bounded_attempts(_attempts(spark, sf_dir), "user_id", ["ts", "event_id"], gone_is_success=False)


def readiness_batch(spark, sf_dir):
    return lc.track_readiness(_status(spark, sf_dir), "user_id", "ts", "status", "event_id", READY_TIMEOUT_S)


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events*.parquet")


def readiness_stream(spark, sf_dir):
    ev = _event_stream(spark, sf_dir)
    st = (F.when(F.col("event_type") == "purchase", F.lit(lc.ACTIVE))
          .when(F.col("event_type") == "error", F.lit(lc.ERROR)).otherwise(F.col("event_type")))
    src = ev.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), st.alias("status"))
    out = track_readiness_stream(src, "user_id", "ts", "status", "event_id", READY_TIMEOUT_S, WATERMARK_DELAY)
    return out.select(F.col("resource").alias("user_id"),
                      F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), "state",
                      F.col("decided_at").cast("timestamp_ntz").alias("decided_at"))


def jobs_batch(spark, sf_dir):
    p = _polls(table(spark, sf_dir, "events"))
    return lc.track_jobs(p, "user_id", "ts", "status", "fail_reason", "event_id").withColumnRenamed(
        "user_id", "job_id")


def jobs_stream(spark, sf_dir):
    p = _polls(_event_stream(spark, sf_dir))
    return track_jobs_stream(p, "user_id", "ts", "status", "fail_reason", "event_id", delay=WATERMARK_DELAY)


def _month_log_files(spark, sf_dir) -> tuple[str, Column]:
    """A glob of freshly written month logs, and the log's name from the file's."""
    root = new_shared_dir(spark, "month-logs-stream")
    write_logs(month_log_lines(spark, sf_dir), root)
    return f"{root}/*/*.txt", F.regexp_extract("file", r"/log=([^/]+)/", 1)


def counters_stream(spark, sf_dir):
    """STR-3: month logs land as files; the per-log totals table is kept current, each
    micro-batch writing the logs that it changed."""
    path, log_name = _month_log_files(spark, sf_dir)
    return run_log_totals(stream_log_counters(spark, path), spark, "counters-stream", log_name)


def counters_stream_rows(spark, sf_dir):
    """STR-3, stateless form: the counter lines themselves, appended."""
    path, log_name = _month_log_files(spark, sf_dir)
    rows = stream_log_counters(spark, path).select(log_name.alias("log"), *logs.COUNTERS)
    return run_available_now(rows, spark, "counters-stream-rows")


QUERIES = {
    "bounded_attempts": bounded_attempts,
    "bounded_attempts_strict": bounded_attempts_strict,
    "readiness_batch": readiness_batch,
    "readiness_stream": readiness_stream,
    "jobs_batch": jobs_batch,
    "jobs_stream": jobs_stream,
    "counters_stream": counters_stream,
    "counters_stream_rows": counters_stream_rows,
}


def _attempts_sql(ok_values: str) -> str:
    return f"""
WITH a AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'signup' THEN 'gone' ELSE 'error' END AS outcome,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events),
k AS (SELECT * FROM a WHERE attempt <= 3)
SELECT user_id,
       coalesce(min(attempt) FILTER (WHERE outcome IN ({ok_values})), count(*)) AS attempts_used,
       min(attempt) FILTER (WHERE outcome IN ({ok_values})) IS NOT NULL AS succeeded,
       min(attempt) FILTER (WHERE outcome IN ({ok_values})) AS success_attempt
FROM k GROUP BY user_id
"""


_READY = """
WITH e AS (SELECT user_id, ts, event_id,
                  CASE event_type WHEN 'purchase' THEN 'ACTIVE' WHEN 'error' THEN 'ERROR' ELSE event_type END AS status
           FROM events),
f AS (SELECT user_id, min(ts) AS t0 FROM e GROUP BY user_id),
t AS (SELECT user_id, ts, status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
      FROM e WHERE status IN ('ACTIVE', 'ERROR')),
r AS (SELECT f.user_id, t0 AS first_seen,
             CASE WHEN t.ts < t0 + INTERVAL 24 HOUR THEN CASE t.status WHEN 'ACTIVE' THEN 'ready' ELSE 'failed' END
                  ELSE 'timed_out' END AS state,
             CASE WHEN t.ts < t0 + INTERVAL 24 HOUR THEN t.ts ELSE t0 + INTERVAL 24 HOUR END AS decided_at
      FROM f LEFT JOIN t ON f.user_id = t.user_id AND t.rn = 1)
"""

_JOBS = """
WITH p AS (SELECT user_id AS job_id, ts,
                  CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAIL' ELSE 'RUNNING' END AS status,
                  CASE WHEN event_type = 'error' THEN props END AS fail_reason,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS poll
           FROM events),
k AS (SELECT * FROM p WHERE poll <= 30),
ft AS (SELECT job_id, min(poll) FILTER (WHERE status IN ('SUCCESS', 'FAIL')) AS fp, max(poll) AS last
       FROM k GROUP BY job_id),
r AS (SELECT ft.job_id,
             CASE WHEN k.status = 'SUCCESS' THEN 'done' WHEN k.status = 'FAIL' THEN 'failed'
                  WHEN last >= 30 THEN 'timed_out' ELSE 'pending' END AS state,
             coalesce(fp, last) AS decided_poll,
             CASE WHEN k.status = 'FAIL' THEN k.fail_reason END AS fail_reason
      FROM ft LEFT JOIN k ON k.job_id = ft.job_id AND k.poll = ft.fp)
"""

ORACLES = {
    "bounded_attempts": _attempts_sql("'ok', 'gone'"),
    "bounded_attempts_strict": _attempts_sql("'ok'"),
    "readiness_batch": _READY + "SELECT * FROM r",
    # The stream reports a decision only once the watermark (max ts - 1 hour) has passed it.
    "readiness_stream": _READY + """
SELECT * FROM r WHERE decided_at < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""",
    "jobs_batch": _JOBS + "SELECT * FROM r",
    "jobs_stream": _JOBS + """
SELECT r.* FROM r JOIN p ON p.job_id = r.job_id AND p.poll = r.decided_poll
WHERE state <> 'pending' AND p.ts < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""",
    "counters_stream": LOG_ORACLES["log_counters"],
    "counters_stream_rows": "WITH " + ORDER_COUNTS_SQL + """
SELECT strftime(o_orderdate, '%Y-%m') AS log, CAST(n - r - a AS BIGINT) AS succeeded, CAST(r AS BIGINT) AS failed,
       CAST(0 AS BIGINT) AS canceled, CAST(a AS BIGINT) AS ignored,
       CAST(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS BIGINT) AS pending
FROM od
UNION ALL
SELECT strftime(o_orderdate, '%Y-%m'), NULL, NULL, NULL, NULL, NULL FROM od WHERE o_orderstatus = 'O'
""",
}
