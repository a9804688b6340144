"""Lifecycle rules (FIXTURES A10, A11) and batch/stream equality."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from suitelens.operators import lifecycle as lc
from suitelens.streaming.lifecycle import track_jobs_stream, track_readiness_stream

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _t(s):
    return T0 + dt.timedelta(seconds=s)


READY_ROWS = [
    ("before", 1, _t(0), "BUILD"), ("before", 2, _t(299), "ACTIVE"),
    ("exact", 3, _t(0), "BUILD"), ("exact", 4, _t(300), "ACTIVE"),
    ("after", 5, _t(0), "BUILD"), ("after", 6, _t(301), "ACTIVE"),
    ("error", 7, _t(0), "ERROR"), ("error", 8, _t(10), "ACTIVE"),
    ("never", 9, _t(0), "BUILD"), ("never", 10, _t(100), "NotFound"),
    ("late_start", 11, _t(5000), "ACTIVE"),
    ("sentinel", 12, _t(100000), "BUILD"),   # pushes the watermark past every deadline
]
EXPECTED_READY = {"before": "ready", "exact": "timed_out", "after": "timed_out", "error": "failed",
                  "never": "timed_out", "late_start": "ready"}


def _ready_df(spark):
    return spark.createDataFrame(READY_ROWS, "resource string, id long, ts timestamp, status string")


def test_readiness_batch(spark):
    got = {r.resource: r.state for r in lc.track_readiness(_ready_df(spark), tiebreak="id").collect()}
    assert {k: got[k] for k in EXPECTED_READY} == EXPECTED_READY
    row = [r for r in lc.track_readiness(_ready_df(spark), tiebreak="id").collect() if r.resource == "never"][0]
    assert row.decided_at == _t(300)


def _as_stream(spark, df):
    d = tempfile.mkdtemp(prefix="suitelens-test-stream-")
    df.write.mode("overwrite").parquet(os.path.join(d, "in"))
    return spark.readStream.schema(df.schema).parquet(os.path.join(d, "in"))


def test_readiness_stream_equals_batch(spark):
    ids = {r: i for i, r in enumerate(sorted({x[0] for x in READY_ROWS}))}
    batch_in = spark.createDataFrame([(ids[r], i, t, s) for r, i, t, s in READY_ROWS],
                                     "rid long, id long, ts timestamp, status string")
    batch = {r.rid: (r.state, r.decided_at) for r in
             lc.track_readiness(batch_in, resource="rid", tiebreak="id").collect()}
    stream = _as_stream(spark, batch_in)
    out = track_readiness_stream(stream, "rid", "ts", "status", "id", 300, "0 seconds")
    got = {r.resource: (r.state, r.decided_at) for r in out.collect()}
    sentinel = ids["sentinel"]
    assert sentinel not in got  # its own deadline is after the last watermark
    assert got == {k: v for k, v in batch.items() if k != sentinel}


def _polls(n_running, last_status, reason=None):
    rows = [(_t(i * 10), "RUNNING", None) for i in range(n_running)]
    if last_status:
        rows.append((_t(n_running * 10), last_status, reason))
    return rows


def test_jobs_batch_and_stream(spark):
    rows = []
    for job, polls in {1: _polls(29, "SUCCESS"), 2: _polls(30, "SUCCESS"), 3: _polls(2, "FAIL", "quota"),
                       4: _polls(5, None)}.items():
        rows += [(job, i, t, s, r) for i, (t, s, r) in enumerate(polls)]
    df = spark.createDataFrame(rows, "job_id long, id long, poll_ts timestamp, status string, fail_reason string")
    got = {r.job_id: (r.state, r.decided_poll, r.fail_reason) for r in lc.track_jobs(df, tiebreak="id").collect()}
    assert got == {1: ("done", 30, None), 2: ("timed_out", 30, None), 3: ("failed", 3, "quota"),
                   4: ("pending", 5, None)}
    later = spark.createDataFrame([(99, 0, _t(10 ** 6), "RUNNING", None)], df.schema)   # moves the watermark
    out = track_jobs_stream(_as_stream(spark, df.unionByName(later)), "job_id", "poll_ts", "status", "fail_reason", "id")
    streamed = {r.job_id: (r.state, r.decided_poll, r.fail_reason) for r in out.collect()}
    assert streamed == {k: v for k, v in got.items() if v[0] != "pending"}


def test_bounded_attempts(spark):
    rows = []
    for res, outcomes in {"first": ["ok"], "third": ["error", "error", "ok"],
                          "fourth": ["error", "error", "error", "ok"], "gone": ["error", "gone"]}.items():
        rows += [(res, i, o) for i, o in enumerate(outcomes)]
    df = spark.createDataFrame(rows, "resource string, i long, outcome string")
    got = {r.resource: (r.attempts_used, r.succeeded) for r in lc.bounded_attempts(df, "resource", ["i"]).collect()}
    assert got == {"first": (1, True), "third": (3, True), "fourth": (3, False), "gone": (2, True)}
    strict = {r.resource: r.succeeded for r in
              lc.bounded_attempts(df, "resource", ["i"], gone_is_success=False).collect()}
    assert strict["gone"] is False


def test_readiness_stream_across_micro_batches(spark):
    """Same answer when events arrive in three files, one micro-batch each (state and
    watermark carried between batches)."""
    import time as _time
    ids = {r: i for i, r in enumerate(sorted({x[0] for x in READY_ROWS}))}
    rows = [(ids[r], i, t, s) for r, i, t, s in READY_ROWS]
    schema = "rid long, id long, ts timestamp, status string"
    d = tempfile.mkdtemp(prefix="suitelens-test-stream3-")
    cuts = [(0, 200), (200, 4000), (4000, 10 ** 9)]
    for n, (lo, hi) in enumerate(cuts):
        part = [x for x in rows if lo <= (x[2] - T0).total_seconds() < hi]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(os.path.join(d, f"in{n}"))
        _time.sleep(1.1)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "in*"))
    out = track_readiness_stream(src, "rid", "ts", "status", "id", 300, "0 seconds")
    got = {r.resource: (r.state, r.decided_at) for r in out.collect()}
    batch = {r.rid: (r.state, r.decided_at) for r in
             lc.track_readiness(spark.createDataFrame(rows, schema), resource="rid", tiebreak="id").collect()}
    assert got == {k: v for k, v in batch.items() if k != ids["sentinel"]}


def test_readiness_stream_in_other_session_time_zone(spark):
    """Decisions must not shift when the session time zone is not UTC."""
    key = "spark.sql.session.timeZone"
    old = spark.conf.get(key)
    spark.conf.set(key, "America/Los_Angeles")
    try:
        ids = {r: i for i, r in enumerate(sorted({x[0] for x in READY_ROWS}))}
        rows = [(ids[r], i, t, s) for r, i, t, s in READY_ROWS]
        df = spark.createDataFrame(rows, "rid long, id long, ts timestamp_ntz, status string")
        batch = {r.rid: (r.state, r.decided_at) for r in
                 lc.track_readiness(df, resource="rid", tiebreak="id").collect()}
        src = _as_stream(spark, df).withColumn("ts", F.col("ts").cast("timestamp"))
        out = track_readiness_stream(src, "rid", "ts", "status", "id", 300, "0 seconds")
        got = {r.resource: (r.state, r.decided_at) for r in
               out.select("resource", "state", F.col("decided_at").cast("timestamp_ntz").alias("decided_at"))
               .collect()}
        assert got == {k: v for k, v in batch.items() if k != ids["sentinel"]}
    finally:
        spark.conf.set(key, old)


def _stream_of_files(spark, name, batches, schema):
    """A stream that reads one file per micro-batch, in this order."""
    import time as _time
    d = tempfile.mkdtemp(prefix=f"suitelens-test-{name}-")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(d, f"in{n}"))
        _time.sleep(1.1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "in*"))


def test_later_events_never_give_a_second_decision(spark):
    schema = "rid long, id long, ts timestamp, status string"
    batches = [[(1, 1, _t(0), "ACTIVE")],
               [(9, 2, _t(10000), "BUILD")],                           # watermark -> 10000 s
               [(1, 3, _t(20000), "BUILD"), (9, 4, _t(30000), "BUILD")],
               [(1, 5, _t(90000), "ERROR")]]
    out = track_readiness_stream(_stream_of_files(spark, "once", batches, schema), "rid", "ts", "status", "id", 300, "0 seconds")
    got = sorted((r.resource, r.state, r.decided_at) for r in out.collect())
    assert got == [(1, "ready", _t(0)), (9, "timed_out", _t(10300))]


def test_streams_equal_batch_on_shuffled_files_with_a_hot_key(spark):
    import random
    rng = random.Random(4)
    rows = []
    for i in range(900):
        key = 0 if i % 3 == 0 else rng.randrange(1, 60)    # one key holds a third of the rows
        rows.append((key, i, _t(rng.randrange(0, 4000)), rng.choice(["BUILD"] * 8 + ["ACTIVE", "ERROR"])))
    rng.shuffle(rows)
    parts = [rows[k::6] for k in range(6)] + [[(999, 10 ** 6, _t(10 ** 6), "BUILD")]]
    schema = "rid long, id long, ts timestamp, status string"
    every = spark.createDataFrame(rows, schema)
    src = _stream_of_files(spark, "shuffled", parts, schema)
    out = track_readiness_stream(src, "rid", "ts", "status", "id", 300, "2 hours")
    batch = lc.track_readiness(every, resource="rid", tiebreak="id")
    assert sorted((r.resource, r.state, r.decided_at) for r in out.collect()) == sorted(
        (r.rid, r.state, r.decided_at) for r in batch.collect())

    def as_polls(df):
        st = F.when(F.col("status") == "ACTIVE", "SUCCESS").when(F.col("status") == "ERROR", "FAIL").otherwise("RUNNING")
        return df.select("rid", "id", "ts", st.alias("status"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("why"))

    out = track_jobs_stream(as_polls(_stream_of_files(spark, "shuffled2", parts, schema)), "rid", "ts", "status", "why", "id",
                            delay="2 hours")
    batch = lc.track_jobs(as_polls(every), "rid", "ts", "status", "why", "id").where("state <> 'pending'")
    key = lambda r: tuple("" if v is None else v for v in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(map(tuple, batch.collect()), key=key)
