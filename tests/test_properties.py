"""Property tests: custom operators against brute-force Python on small random inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from suitelens.functions import columns as C
from suitelens.operators import inventory as inv
from suitelens.operators.ranking import grouped_row_number

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from([None, 0, 1, 2]), st.integers(-50, 50)), min_size=0, max_size=60),
       st.integers(1, 9))
def test_grouped_row_number_matches_sort(spark, rows, parts):
    rows = [(k, v, i) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k int, v int, id long")
    got = {r.id: r.rn for r in grouped_row_number(df, ["k"], ["v", "id"], num_partitions=parts).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        grp = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        want.update({r[2]: i + 1 for i, r in enumerate(grp)})
    assert got == want


HOST = st.text(alphabet="ab-1", min_size=0, max_size=5)


@SETTINGS
@given(st.lists(st.tuples(HOST, st.sampled_from(["", " ", "\t", "#"])), max_size=15),
       st.lists(HOST.filter(lambda h: h != ""), max_size=4))
def test_upsert_matches_python_rule(spark, old, new):
    lines = [pre + h for h, pre in old]
    reg = spark.createDataFrame([(x,) for x in lines], "line string")
    inc = spark.createDataFrame([("10.0.0.1", h) for h in new], "private_ip string, hostname string")
    got = sorted(r.line for r in inv.upsert_registry(reg, inc).collect())
    kept = [x for x in lines if not any(x.strip().endswith(h) for h in new)
            and not x.strip().startswith("#") and x.strip() != ""]
    want = sorted(kept + [f"10.0.0.1\t{h}" for h in new])
    assert got == want


def _walk(networks, explicit):
    private = public = None
    for _, entries in networks:
        for addr, kind in entries:
            if addr:
                if kind == "fixed":
                    private = addr
                elif kind == "floating":
                    public = addr
                break
        if private and public:
            break
    if explicit is not None:
        public = explicit
    return private or "N/A", public or "N/A"


ENTRY = st.tuples(st.sampled_from([None, "", "a", "b", "c"]), st.sampled_from(["fixed", "floating", "other"]))


@SETTINGS
@given(st.lists(st.tuples(st.lists(st.tuples(st.just("n"), st.lists(ENTRY, max_size=3)), max_size=3),
                          st.sampled_from([None, "x"])), min_size=1, max_size=8))
def test_classify_addresses_matches_walk(spark, servers):
    schema = ("i int, networks array<struct<network:string, entries:array<struct<addr:string, ip_type:string>>>>,"
              " publicip string")
    df = spark.createDataFrame([(i, nets, ex) for i, (nets, ex) in enumerate(servers)], schema)
    got = {r.i: (r.private_ip, r.public_ip) for r in inv.classify_addresses(df).collect()}
    assert got == {i: _walk(nets, ex) for i, (nets, ex) in enumerate(servers)}


@SETTINGS
@given(st.lists(st.text(min_size=0, max_size=90), min_size=1, max_size=10),
       st.lists(st.floats(0, 100000, allow_nan=False) | st.integers(0, 800_000).map(lambda x: x / 8 + 0.005)
                | st.integers(0, 10 ** 7).map(lambda x: x / 1000) | st.floats(0, 1e-5), min_size=1, max_size=10))
def test_text_helpers_match_python(spark, texts, secs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", C.shorten_command("t").alias("s")).collect()}
    assert got == {i: t if len(t) < 60 else f"{t[:50]}...[truncated]...{t[-5:]}" for i, t in enumerate(texts)}
    d = spark.createDataFrame([(i, float(s)) for i, s in enumerate(secs)], "i int, v double")
    got = {r.i: r.s for r in d.select("i", C.format_duration("v").alias("s")).collect()}
    want = {}
    for i, s in enumerate(secs):
        m, r = divmod(float(s), 60)
        want[i] = f"{int(m)}m {r:.2f}s"
    assert got == want


def test_durations_near_half_a_hundredth(spark):
    secs = [k / 1000 for k in range(5, 3000, 10)] + [60 + k / 1000 for k in range(5, 500, 10)]
    d = spark.createDataFrame([(s,) for s in secs], "v double")
    got = {r.v: r.s for r in d.select("v", C.format_duration("v").alias("s")).collect()}
    assert got == {s: "{:.0f}m {:.2f}s".format(*divmod(s, 60)) for s in secs}


def test_expiry_time_ltz_any_session_zone(spark):
    import datetime as dt
    key = "spark.sql.session.timeZone"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "Asia/Shanghai")
        df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 12, 0),)], "t timestamp_ntz")
        inst = df.select(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), F.col("t"))
                         .cast("timestamp").alias("t"))   # the instant 2024-01-01T12:00Z
        assert inst.select(C.expiry_time("t", 3, ltz=True).alias("e")).first().e == "2024-01-01T15:00:00Z"
        assert df.select(C.expiry_time("t", 3).alias("e")).first().e == "2024-01-01T15:00:00Z"
    finally:
        spark.conf.set(key, old)


@SETTINGS
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \t\n\r\x0b\x0c\x1c\x85\xa0 　​")),
                        max_size=8), min_size=1, max_size=10))
def test_py_strip_matches_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", C.py_strip("t").alias("s")).collect()}
    assert got == {i: t.strip() for i, t in enumerate(texts)}


@SETTINGS
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \t\x0b\x1c\xa0 　")), max_size=10),
                min_size=1, max_size=10))
def test_py_split_matches_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: list(r.s) for r in df.select("i", C.py_split("t").alias("s")).collect()}
    assert got == {i: t.split() for i, t in enumerate(texts)}


EVENT = st.tuples(st.integers(0, 3), st.integers(0, 900), st.sampled_from(["ACTIVE", "ERROR", "BUILD", "NotFound"]))


def _ready_rule(events, timeout):
    evs = sorted((t, i, s) for i, (t, s) in enumerate(events))
    t0 = evs[0][0]
    for t, _, s in evs:
        if s in ("ACTIVE", "ERROR") and t - t0 < timeout:
            return ("ready" if s == "ACTIVE" else "failed"), t
        if s in ("ACTIVE", "ERROR"):
            break
    return "timed_out", t0 + timeout


@SETTINGS
@given(st.lists(EVENT, min_size=1, max_size=40))
def test_track_readiness_matches_rule(spark, rows):
    import datetime as dt

    from suitelens.operators import lifecycle as lc
    base = dt.datetime(2024, 1, 1)
    data = [(r, i, base + dt.timedelta(seconds=t), s) for i, (r, t, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "resource int, id long, ts timestamp, status string")
    got = {r.resource: (r.state, r.decided_at) for r in lc.track_readiness(df, tiebreak="id", timeout_s=300).collect()}
    want = {}
    for res in {r for r, _, _ in rows}:
        # the rule in plain Python, over (ts, id) order; ids follow list order
        ordered = [(t, s) for t, _, s in sorted((t, i, s) for i, (r, t, s) in enumerate(rows) if r == res)]
        state, at = _ready_rule(ordered, 300)
        want[res] = (state, base + dt.timedelta(seconds=at))
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["SUCCESS", "FAIL", "RUNNING"])), max_size=80),
       st.integers(1, 6))
def test_track_jobs_matches_rule(spark, rows, max_polls):
    import datetime as dt

    from suitelens.operators import lifecycle as lc
    base = dt.datetime(2024, 1, 1)
    data = [(j, i, base + dt.timedelta(seconds=i), s, f"r{i}") for i, (j, s) in enumerate(rows)]
    if not data:
        return
    df = spark.createDataFrame(data, "job_id int, id long, poll_ts timestamp, status string, fail_reason string")
    got = {r.job_id: (r.state, r.decided_poll, r.fail_reason)
           for r in lc.track_jobs(df, tiebreak="id", max_polls=max_polls).collect()}
    want = {}
    for job in {j for j, _ in rows}:
        polls = [(i, s) for i, (j, s) in enumerate(rows) if j == job][:max_polls]
        out = None
        for n, (i, s) in enumerate(polls, start=1):
            if s == "SUCCESS":
                out = ("done", n, None)
                break
            if s == "FAIL":
                out = ("failed", n, f"r{i}")
                break
        if out is None:
            out = ("timed_out" if len(polls) >= max_polls else "pending", len(polls), None)
        want[job] = out
    assert got == want
