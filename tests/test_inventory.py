"""Inventory operators (FIXTURES A3-A8) and skew-safe numbering."""

from pyspark.sql import functions as F

from suitelens.operators import inventory as inv
from suitelens.operators.ranking import grouped_row_number


def test_grouped_row_number_hot_key(spark):
    # one key holds most rows; numbering must be exact across many range partitions
    df = spark.range(0, 5000).select(F.when(F.col("id") % 10 < 8, F.lit(1)).otherwise(F.col("id") % 7)
                                     .alias("k"), F.col("id"))
    out = grouped_row_number(df, ["k"], ["id"], "rn", num_partitions=16)
    rows = out.collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r.k, []).append((r.id, r.rn))
    for k, pairs in by_key.items():
        pairs.sort()
        assert [rn for _, rn in pairs] == list(range(1, len(pairs) + 1)), k
    assert len(rows) == 5000


def test_grouped_row_number_null_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, id long")
    got = sorted((r.k, r.id, r.rn) for r in grouped_row_number(df, ["k"], ["id"]).collect()
                 if r.k is None)
    assert got == [(None, 1, 1), (None, 2, 2)]


def test_pair_by_position(spark):
    left = spark.createDataFrame([("r1", 3), ("r1", 1), ("r1", 2), ("r2", 9)], "run string, i long")
    right = spark.createDataFrame([("r1", "b"), ("r1", "a")], "run string, ip string")
    out = sorted((r.run, r.i, r.ip) for r in inv.pair_by_position(left, right, "run", ["i"], ["ip"]).collect())
    assert out == [("r1", 1, "a"), ("r1", 2, "b"), ("r1", 3, None), ("r2", 9, None)]


def test_resolve_public_ip(spark):
    insts = spark.createDataFrame([(1, "e1", None), (2, "e9", "5.5.5.5"), (3, None, None)],
                                  "index int, eip_id string, public_ip string")
    addrs = spark.createDataFrame([("e1", "1.1.1.1", 2), ("e1", "2.2.2.2", 1)], "id string, ip string, list_pos int")
    got = {r["index"]: r.resolved_ip for r in inv.resolve_public_ip(insts, addrs).collect()}
    assert got == {1: "2.2.2.2", 2: "5.5.5.5", 3: "N/A"}


def test_upsert_registry_suffix_rule(spark):
    reg = spark.createDataFrame([("127.0.0.1\tlocalhost",), ("10.0.0.1\tnode-1",), ("10.0.0.2\txnode-1 ",),
                                 ("# comment",), ("",), ("10.0.0.3\tnode-2",), ("10.0.0.4\tnode-10",)], "line string")
    new = spark.createDataFrame([("192.168.0.1", "node-1")], "private_ip string, hostname string")
    got = sorted((r.line, r.source) for r in inv.upsert_registry(reg, new).collect())
    assert got == [("10.0.0.3\tnode-2", "kept"), ("10.0.0.4\tnode-10", "kept"),
                   ("127.0.0.1\tlocalhost", "kept"), ("192.168.0.1\tnode-1", "new")]


def test_upsert_registry_empty_incoming(spark):
    reg = spark.createDataFrame([("a\tb",), ("#c",)], "line string")
    new = spark.createDataFrame([], "private_ip string, hostname string")
    assert [r.line for r in inv.upsert_registry(reg, new).collect()] == ["a\tb"]


def test_classify_addresses(spark):
    schema = ("id int, networks array<struct<network:string, entries:array<struct<addr:string, ip_type:string>>>>,"
              " publicip string")
    rows = [
        (1, [("n", [("10.0.0.1", "fixed"), ("1.1.1.1", "floating")])], None),   # only first entry counts
        (2, [("a", [("10.0.0.1", "fixed")]), ("b", [("1.1.1.1", "floating")])], None),
        (3, [("a", [("", "fixed"), ("10.0.0.2", "fixed")])], None),              # empty addr skipped
        (4, [], None),
        (5, [("a", [("10.0.0.1", "fixed")])], "9.9.9.9"),                         # explicit wins
        (6, [("a", [("10.0.0.1", "fixed")]), ("b", [("1.1.1.1", "floating")]),
             ("c", [("10.0.0.9", "fixed")])], None),                               # stop when both set
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: (r.private_ip, r.public_ip) for r in inv.classify_addresses(df).collect()}
    assert got == {1: ("10.0.0.1", "N/A"), 2: ("10.0.0.1", "1.1.1.1"), 3: ("10.0.0.2", "N/A"),
                   4: ("N/A", "N/A"), 5: ("10.0.0.1", "9.9.9.9"), 6: ("10.0.0.1", "1.1.1.1")}


def test_filters(spark):
    df = spark.createDataFrame([(1, "N/A"), (2, None), (3, "1.1.1.1")], "i int, public_ip string")
    assert sorted(r.i for r in inv.addressable(df).collect()) == [2, 3]
    lines = spark.createDataFrame([("1.1.1.1 node1-a.b",), ("1.1.1.1 node1-aXb",), ("1.1.1.1 xnode1-a.b",),
                                   ("1.1.1.1 node-1",)], "line string")
    assert sorted(r.line for r in inv.drop_node_lines(lines, "a.b").collect()) == [
        "1.1.1.1 node-1", "1.1.1.1 node1-aXb", "1.1.1.1 xnode1-a.b"]
    jobs = spark.createDataFrame([(1, [("FAIL", "volume", "busy"), ("SUCCESS", "server", None)])],
                                 "job_id int, sub_jobs array<struct<status:string,type:string,fail_reason:string>>")
    assert [tuple(r) for r in inv.failed_sub_jobs(jobs).collect()] == [(1, "volume", "busy")]


def test_tallies(spark):
    out = spark.createDataFrame([("r", True), ("r", False), ("r", False)], "run string, ok boolean")
    t = inv.tally_outcomes(out, "run").collect()[0]
    assert (t.total, t.succeeded, t.failed) == (3, 1, 2)
    req = spark.createDataFrame([("r",), ("empty",)], "run string")
    for on_empty in (True, False):
        got = {r.run: r.all_ok for r in inv.all_succeeded(req, out, "run", on_empty=on_empty).collect()}
        assert got == {"r": False, "empty": on_empty}
    reqs = spark.createDataFrame([("r", 5), ("s", 1)], "run string, requested int")
    sf = {r.run: (r.created, r.missing, r.enough) for r in inv.shortfall(reqs, out, "run").collect()}
    assert sf == {"r": (3, 2, False), "s": (0, 1, False)}
    kinds = spark.createDataFrame([(1, "e"), (2, None)], "id int, eip string")
    assert sorted(tuple(r) for r in inv.count_by_kind(kinds, {"instances": "*", "eips": "eip"}).collect()) == [
        ("eips", 1), ("instances", 2)]


def test_first_with_prefix(spark):
    df = spark.createDataFrame([("r", "node1-x", 1), ("r", "node0-x", 3), ("r", "node0-y", 2), ("s", "n", 1)],
                               "run string, hostname string, pos int")
    runs = spark.createDataFrame([("r",), ("s",)], "run string")
    got = {r.run: r.first_hostname for r in inv.first_with_prefix(df, "run", "hostname", "node0-", "pos", runs)
           .collect()}
    assert got == {"r": "node0-y", "s": None}


def test_append_rows_by_name(spark):
    a = spark.createDataFrame([("p", 1, 2)], "Path string, NumTests int, NumFails int")
    b = spark.createDataFrame([(5, "Total")], "NumTests int, Path string")
    got = sorted(tuple(r) for r in inv.append_rows(a, b).collect())
    assert got == [("Total", 5, None), ("p", 1, 2)]


def test_numbering_carries_over_partitions(spark):
    """Keys that end and begin within, at and over partition bounds; nulls; many keys; many partitions."""
    import random

    from pyspark.sql import Window
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.1 else rng.choice(["hot"] * 6 + ["a", "b", "c", str(rng.randrange(300))]), rng.randrange(3), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, j int, id long")
    for keys in (["k"], ["k", "j"], []):
        want = df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("id")).cast("long"))
        for n in (1, 3, 40, 200):
            got = grouped_row_number(df, keys, ["id"], "rn", num_partitions=n)
            assert sorted((r.id, r.rn) for r in got.collect()) == sorted((r.id, r.rn) for r in want.collect())


def test_numbering_shuffles_rows_once_and_joins_at_most_a_row_per_partition(spark):
    import contextlib
    import io
    df = spark.range(20_000).select((F.col("id") % 19_000).alias("k"), "id")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        grouped_row_number(df, ["k"], ["id"], "rn", num_partitions=8).explain()
    p = buf.getvalue()
    # what is left after the rows were written: scans, and joins with broadcast tables of one row per partition
    assert "SortMergeJoin" not in p and "BroadcastHashJoin" in p and "k#" in p
    assert "Exchange hashpartitioning(k" not in p and "rangepartitioning" not in p


def test_run_stamp_and_megabytes(spark):
    import datetime as dt

    from suitelens.functions import columns as C
    sizes = [0, 1, 5242, 5243, 131072, 393216, 1048575, 1048576, 123456789, 10 ** 15 + 7, (1 << 62) + 12345, *range(131000, 131200, 7)]
    times = [dt.datetime(2024, 1, 31, 23, 59, 59), dt.datetime(1999, 12, 1, 0, 0, 1, 999999)]
    df = spark.createDataFrame([(n,) for n in sizes] + [(None,)], "n long")
    got = {r.n: r.mb for r in df.select("n", C.megabytes("n").alias("mb")).collect()}
    from fractions import Fraction
    for n in sizes:
        cents = round(Fraction(100 * n, 1 << 20))  # ties to even
        assert got[n] == f"{cents // 100}.{cents % 100:02d} MB"
        if n < 1 << 53:
            assert got[n] == f"{n / (1024 * 1024):.2f} MB"
    assert got[None] is None
    stamps = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz").select(C.run_stamp("t").alias("s")).collect()
    assert [r.s for r in stamps] == [t.strftime("%Y%m%d_%H%M%S") for t in times]
