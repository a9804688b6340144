"""Queries for log mining: log_counters, log_stat_lines, log_verdict, module_report, tail_lines, file_tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suitelens.operators import logs
from suitelens.plans.fixtures import order_line_counts
from suitelens.session import new_shared_dir, table
from suitelens.sinks.files import write_documents
from suitelens.sources.logs import scan_log_lines
from suitelens.sources.tails import tail_files

# Patterns for FLT-2 over the documents table (a parameter of stat_lines).
DOC_PATTERNS = ("License", "password", "@")


def counter_line(n, r, a, pending):
    return F.format_string("[info] Tests: succeeded %d, failed %d, canceled %d, ignored %d, pending %d",
                           n - r - a, r, F.lit(0), a, pending)


def month_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``log, value``: one log per order month; per order a counter line and a noise line;
    status O orders add a ``Tests:`` line without counters."""
    od = order_line_counts(spark, sf_dir)
    k = F.col("o_orderkey").cast("string")
    pending = F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    lines = F.array(
        counter_line(F.col("n"), F.col("r"), F.col("a"), pending),
        F.concat(F.lit("[info] - order "), k, F.lit(" priority "), F.col("o_orderpriority")),
        F.when(F.col("o_orderstatus") == "O",
               F.concat(F.lit("[info] Tests: none were executed for order "), k)))
    return (od.select(F.date_format("o_orderdate", "yyyy-MM").alias("log"),
                      F.explode(lines).alias("value"))
            .where(F.col("value").isNotNull()))


def write_logs(lines: DataFrame, root: str) -> None:
    """Log lines under ``root/log=<name>/``: every task writes its own part of each log it
    holds, so a log with a third of all lines is still written by many tasks."""
    lines.write.mode("overwrite").partitionBy("log").text(root)


def log_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3 + PRJ-2: counters mined from log files written from the order tables."""
    root = new_shared_dir(spark, "month-logs")
    write_logs(month_log_lines(spark, sf_dir), root)
    scanned = scan_log_lines(spark, root, glob="*.txt")
    scanned = scanned.withColumn("log", F.regexp_extract("file", r"/log=([^/]+)/", 1))
    return logs.log_counter_totals(logs.extract_log_counters(scanned), key="log")


def log_stat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-2 over every line of every document (whole texts)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "value"))
    return logs.stat_lines(lines, DOC_PATTERNS).select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("value").alias("line"))


def customer_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, module, value``: one log per customer, module = nation name.

    Per order: a counter line and a ``Total number of tests run`` line; customers
    with a positive balance also print the pass phrase.
    """
    return _with_module(spark, sf_dir, _customer_lines(spark, sf_dir))


def _customer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``c_custkey, value``"""
    od = order_line_counts(spark, sf_dir)
    pending = F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    order_lines = od.select(
        F.col("o_custkey").alias("c_custkey"),
        F.explode(F.array(counter_line(F.col("n"), F.col("r"), F.col("a"), pending),
                          F.format_string("Total number of tests run: %d", F.col("n")))).alias("value"))
    pass_lines = (table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0)
                  .select("c_custkey", F.lit("All tests passed.").alias("value")))
    return order_lines.unionByName(pass_lines)


def _with_module(spark: SparkSession, sf_dir: str, logs_: DataFrame) -> DataFrame:
    """Rows of customer logs with ``file`` and ``module`` in the place of the customer."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (logs_.join(cust, "c_custkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("n_name").alias("module"), F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("file"),
                    *[c for c in logs_.columns if c != "c_custkey"]))


def log_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-6 per customer log: lines are reduced to one row per log before any join."""
    return _with_module(spark, sf_dir, logs.log_verdict(_customer_lines(spark, sf_dir), key="c_custkey"))


def module_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-7: per nation, pass iff every customer log passed."""
    return logs.module_report(log_verdict(spark, sf_dir), "module")


def tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-2: last 20 events per user by (ts, event_id)."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return logs.tail_lines(ev, "user_id", ["ts", "event_id"]).select(
        "user_id", "event_id", F.col("from_end").cast("long").alias("from_end"))


def file_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-2 on files: the last 20 lines of each document, written as a file of its own and read from its end."""
    root = new_shared_dir(spark, "document-files")
    docs = table(spark, sf_dir, "documents").select(
        F.format_string("%d/%d.txt", F.pmod("doc_id", F.lit(100)), F.col("doc_id")).alias("path"),
        F.coalesce("text", F.lit("")).alias("content"))
    write_documents(docs, root)
    return tail_files(spark, root, glob="*.txt").select(
        F.regexp_extract("file", r"(-?\d+)\.txt$", 1).cast("long").alias("doc_id"),
        F.col("from_end").cast("long").alias("from_end"), F.col("value").alias("line"))


QUERIES = {
    "log_counters": log_counters,
    "log_stat_lines": log_stat_lines,
    "log_verdict": log_verdict,
    "module_report": module_report,
    "tail_lines": tail_lines,
    "file_tails": file_tails,
}

ORDER_COUNTS_SQL = """
li AS (SELECT l_orderkey, count(*) AS n,
              count(*) FILTER (WHERE l_returnflag = 'R') AS r,
              count(*) FILTER (WHERE l_returnflag = 'A') AS a
       FROM lineitem GROUP BY l_orderkey),
od AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate,
              coalesce(n, 0) AS n, coalesce(r, 0) AS r, coalesce(a, 0) AS a
       FROM orders LEFT JOIN li ON l_orderkey = o_orderkey)
"""

_VERDICT = "WITH " + ORDER_COUNTS_SQL + """,
per_cust AS (SELECT o_custkey, count(*) AS n_orders,
                    bool_or(r = 0 AND o_orderstatus <> 'P') AS clean
             FROM od GROUP BY o_custkey),
v AS (
  SELECT n_name AS module, 'cust-' || c_custkey AS file,
         CAST(2 * coalesce(n_orders, 0) + CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_stat_lines,
         c_acctbal > 0 AS has_pass_phrase,
         coalesce(clean, false) AS has_clean_counters
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN per_cust ON o_custkey = c_custkey
  WHERE n_orders IS NOT NULL OR c_acctbal > 0)
"""

ORACLES = {
    "log_counters": "WITH " + ORDER_COUNTS_SQL + """
SELECT strftime(o_orderdate, '%Y-%m') AS log,
       CAST(count(*) + count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS n_counter_lines,
       CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS n_unparsed,
       CAST(sum(n - r - a) AS BIGINT) AS succeeded, CAST(sum(r) AS BIGINT) AS failed,
       CAST(0 AS BIGINT) AS canceled, CAST(sum(a) AS BIGINT) AS ignored,
       CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS pending
FROM od GROUP BY 1
""",
    "log_stat_lines": """
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS line_no, unnest(p) AS line FROM parts)
SELECT doc_id, line_no, line FROM lines
WHERE regexp_matches(line, 'License|password|@')
""",
    "log_verdict": _VERDICT + """
SELECT module, file, n_stat_lines, has_pass_phrase, has_clean_counters,
       n_stat_lines > 0 AND has_pass_phrase AND has_clean_counters AS passed
FROM v
""",
    "module_report": _VERDICT + """
SELECT module AS name, count(*) AS n_logs,
       count(*) FILTER (WHERE n_stat_lines > 0 AND has_pass_phrase AND has_clean_counters) AS n_passed,
       CASE WHEN bool_and(n_stat_lines > 0 AND has_pass_phrase AND has_clean_counters) THEN 'pass' ELSE 'fail' END AS result
FROM v GROUP BY module
""",
    "tail_lines": """
SELECT user_id, event_id, from_end FROM (
  SELECT user_id, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS from_end
  FROM events) WHERE from_end <= 20
""",
    "file_tails": """
WITH ended AS (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END AS t
               FROM documents WHERE text <> ''),
parts AS (SELECT doc_id, string_split(t, chr(10)) AS p FROM ended),
places AS (SELECT doc_id, p, unnest(generate_series(1, least(len(p), 20))) AS from_end FROM parts)
SELECT doc_id, from_end, p[len(p) - from_end + 1] AS line FROM places
""",
}
