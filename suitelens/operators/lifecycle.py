"""Lifecycle rules over status events, batch form.

WIN-1 bounded_attempts, STR-1 track_readiness, STR-2 track_jobs.
The streaming forms with the same rules are in ``suitelens.streaming.lifecycle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values from the reference's polling rules
MAX_ATTEMPTS = 3            # max_retries (2) + 1
READY, FAILED, TIMED_OUT, DONE, PENDING = "ready", "failed", "timed_out", "done", "pending"
ACTIVE, ERROR = "ACTIVE", "ERROR"
SUCCESS, FAIL = "SUCCESS", "FAIL"
READY_TIMEOUT_S = 300
MAX_POLLS = 30


def _rank_first(df: DataFrame, key: str, order: list, k: int, out: str) -> DataFrame:
    """First ``k`` rows per key (window group limit: k rows per key per map task are shuffled)."""
    w = Window.partitionBy(key).orderBy(*[F.col(c) for c in order])
    return df.withColumn(out, F.row_number().over(w).cast("long")).where(F.col(out) <= k)


def bounded_attempts(attempts: DataFrame, resource: str, order: list, outcome_col: str = "outcome",
                     max_attempts: int = MAX_ATTEMPTS, gone_is_success: bool = True) -> DataFrame:
    """WIN-1: ``resource, attempts_used, succeeded, success_attempt``.

    Only the first ``max_attempts`` recorded attempts count; the first success ends
    the run. ``gone`` (resource already deleted) counts as success when
    ``gone_is_success`` (the two copies of the deletion loop differ on this).
    """
    ok_values = ["ok", "gone"] if gone_is_success else ["ok"]
    kept = _rank_first(attempts, resource, order, max_attempts, "attempt")
    ok = F.col(outcome_col).isin(ok_values)
    agg = kept.groupBy(resource).agg(
        F.min(F.when(ok, F.col("attempt"))).alias("success_attempt"),
        F.count(F.lit(1)).alias("_n"))
    return agg.select(resource,
                      F.coalesce("success_attempt", "_n").alias("attempts_used"),
                      F.col("success_attempt").isNotNull().alias("succeeded"),
                      "success_attempt")


def track_readiness(events: DataFrame, resource: str = "resource", ts: str = "ts", status: str = "status",
                    tiebreak: str | None = None, timeout_s: int = READY_TIMEOUT_S) -> DataFrame:
    """STR-1: ``resource, first_seen, state, decided_at``.

    From the first event of a resource, the first terminal status seen strictly
    within ``timeout_s`` decides: ACTIVE -> ready, ERROR -> failed; otherwise the
    resource timed out at first_seen + timeout. Other statuses (not found, request
    errors) are transient. One aggregation with map-side combine: the earliest
    terminal event decides, so no window over a resource's events is needed.
    """
    order = [F.col(ts)] + ([F.col(tiebreak)] if tiebreak else [])
    terminal = F.col(status).isin(ACTIVE, ERROR)
    first_term = F.min(F.when(terminal, F.struct(*order, F.col(status).alias("_st"))))
    g = events.groupBy(resource).agg(F.min(ts).alias("first_seen"), first_term.alias("_ft"))
    deadline = F.col("first_seen") + F.expr(f"INTERVAL {int(timeout_s)} SECONDS")
    in_time = F.col("_ft").isNotNull() & (F.col(f"_ft.{ts}") < deadline)
    state = (F.when(in_time & (F.col("_ft._st") == ACTIVE), F.lit(READY))
             .when(in_time, F.lit(FAILED)).otherwise(F.lit(TIMED_OUT)))
    decided = F.when(in_time, F.col(f"_ft.{ts}")).otherwise(deadline)
    return g.select(resource, "first_seen", state.alias("state"), decided.alias("decided_at"))


def track_jobs(polls: DataFrame, job: str = "job_id", ts: str = "poll_ts", status: str = "status",
               reason: str = "fail_reason", tiebreak: str | None = None,
               max_polls: int = MAX_POLLS) -> DataFrame:
    """STR-2: ``job, state, decided_poll, fail_reason`` from the first ``max_polls`` polls.

    SUCCESS -> done, FAIL -> failed (with its reason), neither within ``max_polls``
    polls -> timed_out at poll ``max_polls``. A job with fewer polls and no terminal
    status is still ``pending`` (the stream form emits nothing for it yet).
    """
    order = [ts] + ([tiebreak] if tiebreak else [])
    kept = _rank_first(polls, job, order, max_polls, "poll")
    terminal = F.col(status).isin(SUCCESS, FAIL)
    first_term = F.min(F.when(terminal, F.struct(F.col("poll"), F.col(status).alias("_st"),
                                                 F.col(reason).alias("_re"))))
    g = kept.groupBy(job).agg(first_term.alias("_ft"), F.max("poll").alias("_last"))
    state = (F.when(F.col("_ft._st") == SUCCESS, F.lit(DONE))
             .when(F.col("_ft._st") == FAIL, F.lit(FAILED))
             .when(F.col("_last") >= max_polls, F.lit(TIMED_OUT)).otherwise(F.lit(PENDING)))
    return g.select(job, state.alias("state"),
                    F.coalesce(F.col("_ft.poll"), F.col("_last")).alias("decided_poll"),
                    F.when(F.col("_ft._st") == FAIL, F.col("_ft._re")).alias("fail_reason"))
