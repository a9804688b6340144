"""Queries for the report roll-up (E1): suite_summary, report_quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suitelens.operators import suites
from suitelens.plans.fixtures import REPORT_DOCS_SQL, SUMMARY_SQL, report_documents


def suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-1 + FLT-1 + AGG-1 + ORD-1 over one XML document per order."""
    return suites.summarize(report_documents(spark, sf_dir))


def report_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-1: quarantined documents counted per priority folder."""
    bad = suites.quarantine(report_documents(spark, sf_dir))
    return (bad.groupBy(F.regexp_extract("Path", r"^reports/([^/]+)/", 1).alias("priority"))
            .agg(F.count(F.lit(1)).alias("n_bad")))


QUERIES = {
    "suite_summary": suite_summary,
    "report_quarantine": report_quarantine,
}

ORACLES = {
    "suite_summary": SUMMARY_SQL,
    "report_quarantine": "WITH " + REPORT_DOCS_SQL + """
SELECT o_orderpriority AS priority, count(*) AS n_bad FROM docs
WHERE o_orderstatus = 'P' GROUP BY o_orderpriority
""",
}
