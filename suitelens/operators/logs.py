"""Test-log mining: FLT-2 stat_lines, PRJ-2 extract_log_counters, AGG-6 log_verdict,
AGG-7 module_report, ORD-2 tail_lines, and the per-log counter roll-up.

All built-in expressions: a log line never leaves the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what the test runner prints
STAT_PATTERNS = ("Total number of tests run:", "Tests: succeeded", "All tests passed")
COUNTER_MARK = "Tests:"
COUNTER_REGEX = (r"succeeded ([0-9]+), failed ([0-9]+), canceled ([0-9]+), "
                 r"ignored ([0-9]+), pending ([0-9]+)")
COUNTERS = ("succeeded", "failed", "canceled", "ignored", "pending")
PASS_REGEX = "All tests passed."
CLEAN_REGEX = r"Tests: succeeded [0-9]+, failed 0, canceled 0, ignored [0-9]+, pending 0"
TAIL_LINES = 20


def stat_lines(lines: DataFrame, patterns=STAT_PATTERNS, value_col: str = "value",
               literal: bool = True) -> DataFrame:
    """FLT-2: keep lines containing any of ``patterns`` (literal text unless ``literal=False``)."""
    rx = "|".join(re.escape(p) for p in patterns) if literal else "|".join(patterns)
    return lines.where(F.col(value_col).rlike(rx))


def extract_log_counters(lines: DataFrame, value_col: str = "value",
                         as_strings: bool = False) -> DataFrame:
    """PRJ-2: rows for lines containing ``Tests:``, with the five counters.

    A ``Tests:`` line that does not match the counter pattern still yields a row,
    with NULL counters (empty strings with ``as_strings=True``, as the JSON sink prints).
    """
    v = F.col(value_col)
    marked = lines.where(v.contains(COUNTER_MARK))
    cols = []
    for i, name in enumerate(COUNTERS, start=1):
        raw = F.regexp_extract(v, COUNTER_REGEX, i)
        cols.append((raw if as_strings else raw.try_cast("long")).alias(name))
    return marked.select("*", *cols)


def log_counter_records(lines: DataFrame, key="file", value_col: str = "value") -> DataFrame:
    """PRJ-2 with every log: a row of strings per ``Tests:`` line, and one with NULL counters
    and ``no_match`` for each log that has no such line."""
    keys = _keys(key)
    found = extract_log_counters(lines, value_col, as_strings=True).select(*keys, *COUNTERS, F.lit(False).alias("no_match"))
    none = (lines.groupBy(*keys).agg(F.bool_or(F.col(value_col).contains(COUNTER_MARK)).alias("_any"))
            .where(~F.coalesce("_any", F.lit(False)))
            .select(*keys, *[F.lit(None).cast("string").alias(c) for c in COUNTERS], F.lit(True).alias("no_match")))
    return found.unionByName(none)


def _keys(key):
    return [key] if isinstance(key, str) else list(key)


def log_counter_totals(counters: DataFrame, key="file") -> DataFrame:
    """Sum of each counter per log plus the number of counter lines and of unparsed ones."""
    return counters.groupBy(*_keys(key)).agg(
        F.count(F.lit(1)).alias("n_counter_lines"),
        F.count_if(F.col("succeeded").isNull()).alias("n_unparsed"),
        *[F.sum(c).alias(c) for c in COUNTERS])


def log_verdict(lines: DataFrame, key="file", value_col: str = "value") -> DataFrame:
    """AGG-6: a log passes iff it has the pass phrase and a clean counter line.

    A log with no statistics line at all fails. One partial aggregation per log.
    """
    v = F.col(value_col)
    stat_rx = "|".join(re.escape(p) for p in STAT_PATTERNS)
    agg = lines.groupBy(*_keys(key)).agg(
        F.count_if(v.rlike(stat_rx)).alias("n_stat_lines"),
        F.bool_or(v.rlike(PASS_REGEX)).alias("has_pass_phrase"),
        F.bool_or(v.rlike(CLEAN_REGEX)).alias("has_clean_counters"))
    return agg.withColumn(
        "passed", (F.col("n_stat_lines") > 0) & F.col("has_pass_phrase") & F.col("has_clean_counters"))


def module_report(verdicts: DataFrame, module_col: str = "module") -> DataFrame:
    """AGG-7: ``name | result`` per module: pass iff every log of the module passed."""
    return verdicts.groupBy(F.col(module_col).alias("name")).agg(
        F.count(F.lit(1)).alias("n_logs"),
        F.count_if("passed").alias("n_passed"),
        F.when(F.bool_and("passed"), F.lit("pass")).otherwise(F.lit("fail")).alias("result"))


def tail_lines(df: DataFrame, key, order, n: int = TAIL_LINES, out: str = "from_end") -> DataFrame:
    """ORD-2: the last ``n`` rows per ``key`` by ``order``; ``from_end`` = 1 is the last row.

    Planned as a window group limit: each map task keeps n rows per key before the
    shuffle, so a hot key moves n rows per task, not all of its rows.
    """
    keys = _keys(key)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order_cols])
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def tail_log_lines(lines: DataFrame, n: int = TAIL_LINES) -> DataFrame:
    """ORD-2 on scanned log files (``file, block, seq, value``): the last ``n`` lines of
    each file in file order, ``from_end`` = 1 being the last line. In-file order is
    (split offset, sequence inside the split), which holds when a file is split."""
    return tail_lines(lines, "file", ["block", "seq"], n)
