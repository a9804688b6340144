"""Scale properties of the physical plans, kept as regression tests.

These read Spark's own ``explain`` output for the registered queries: no query
may use a nested-loop or cartesian join, every top-k per key must be planned as a
partial window group limit (k rows per key per task cross the shuffle), the
skew-safe numbering must range-partition, and pure projections must stay free of
Python and shuffles.
"""

import contextlib
import importlib
import io
import os
import sys

import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
entry = importlib.import_module("__spark_entry__")
SF = "/root/testdata/sf0.001"
from suitelens.plans import all_queries  # noqa: E402

QUERIES = {k: entry.queries()[k] for k in all_queries()}


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(fn(spark, SF)) for name, fn in QUERIES.items()}


def test_no_nested_loop_or_cartesian_join(plans):
    bad = [n for n, p in plans.items() if "BroadcastNestedLoopJoin" in p or "CartesianProduct" in p]
    assert bad == []


@pytest.mark.parametrize("name", ["tail_lines", "bounded_attempts", "bounded_attempts_strict", "jobs_batch"])
def test_top_k_is_a_partial_window_group_limit(plans, name):
    p = plans[name]
    assert "WindowGroupLimit" in p and "Partial" in p


def test_numbering_is_range_partitioned(spark):
    from suitelens.operators.ranking import ranged_rows
    p = plan_of(ranged_rows(spark.range(1000), [F.col("id")], 8))
    assert "rangepartitioning" in p and "SinglePartition" not in p


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_numbering_with_payload_equals_the_plain_window(spark, reuse):
    from pyspark.sql import Window

    from suitelens.operators.ranking import grouped_row_number
    df = spark.range(120_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).alias("k"),
                                     F.xxhash64("id").alias("o"), F.concat(F.lit("payload "), F.col("id").cast("string")).alias("text"))
    keys = ("spark.sql.adaptive.enabled", "spark.sql.exchange.reuse")
    old = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.set(k, reuse)
        got = grouped_row_number(df, ["k"], ["o"], "rn", num_partitions=8)
        want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o")).cast("long"))
        assert got.count() == 120_000 and got.select("k", "o", "text", F.col("rn").cast("long")).exceptAll(want).count() == 0
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["named_resources", "expiry", "short_command", "durations", "address_classes",
                                  "addressable", "drop_node_lines", "failed_sub_jobs", "log_stat_lines"])
def test_projections_stay_in_the_jvm_without_shuffles(plans, name):
    p = plans[name]
    assert "Exchange" not in p and "Python" not in p and "MapInPandas" not in p


def test_scans_read_only_needed_columns(plans):
    # the projection queries never read all columns of their table
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plans["durations"]
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plans["short_command"]


def test_hot_key_is_split_over_range_partitions(spark):
    # one key holds half of all rows: range partitioning on (key, order) spreads it
    df = spark.range(0, 40000).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("k"),
                                      "id")
    sizes = [r["n"] for r in df.repartitionByRange(16, "k", "id").groupBy(F.spark_partition_id().alias("p"))
             .agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * (40000 / 16)


# ---- frames behind the queries that only show the read-back of what they wrote

@pytest.mark.parametrize("reader", ["read_addresses", "read_id_list"])
def test_line_readers_have_no_python_and_shuffle_no_lines(spark, tmp_path, reader):
    from suitelens.sources import inventory
    (tmp_path / "a.txt").write_text("ID\tIP\na\t1\n")
    p = plan_of(getattr(inventory, reader)(spark, str(tmp_path)))
    assert "Python" not in p and "MapInPandas" not in p
    # the one shuffle is of each file's least line number; lines meet it by broadcast
    assert p.count("Exchange hashpartitioning") == 1 and "partial_min" in p and "SortMergeJoin" not in p


def test_report_parse_is_one_pass_over_file_names(spark, tmp_path):
    from suitelens.operators import suites
    from suitelens.sources.reports import scan_reports
    (tmp_path / "TEST-a.xml").write_text('<testsuite tests="1"/>')
    p = plan_of(suites.summarize(scan_reports(spark, str(tmp_path))))
    assert p.count("MapInPandas") == 1 and "binaryFile" not in p and "BroadcastNestedLoopJoin" not in p
    assert "content" not in p  # contents never pass through Spark


def test_counter_records_reduce_before_they_shuffle(spark):
    from suitelens.operators import logs
    from suitelens.plans.logs import month_log_lines
    p = plan_of(logs.log_counter_records(month_log_lines(spark, SF), key="log"))
    assert "partial_bool_or" in p or "partial_max" in p


@pytest.mark.parametrize("name,left", [("failed_ids", "l_orderkey"), ("shortfall", "l_orderkey")])
def test_right_side_is_reduced_before_the_join(plans, name, left):
    p = plans[name]
    join = p[p.index("Join"):]
    assert join.count("HashAggregate(keys=[" + left) >= 1 or "HashAggregate(keys=[_sk" in join


def test_lines_are_reduced_before_the_joins(plans):
    p = plans["log_verdict"]
    assert p.index("Join") < p.index("HashAggregate(keys=[c_custkey")


@pytest.mark.parametrize("name", ["registry_upsert", "shard_assignment", "shard_cover", "failed_ids", "suite_summary"])
def test_building_starts_no_job(spark, name):
    sc = spark.sparkContext
    group = f"build-{name}"
    QUERIES["count_by_kind"](spark, SF)  # ships the package
    sc.setJobGroup(group, name)
    try:
        QUERIES[name](spark, SF)
        jobs = list(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setJobGroup("none", "none")
    # reading a parquet table's schema is a job of its own kind; no table is scanned
    assert len(jobs) <= 4
