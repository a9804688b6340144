"""Inventory readers: SRC-4 read_addresses, SRC-5 read_id_list, SRC-6 read_nodes,
and the reader for SNK-2's instance TSV.

The line-based readers need "is this the first line of its file". A file may be
split over several tasks, so this is computed, not assumed: it is the line with the
least number within the file's offset-0 split.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suitelens.functions.columns import py_split, py_strip
from suitelens.operators.inventory import NA
from suitelens.sources.logs import scan_log_lines

INVENTORY_SCHEMA = ("index long, id string, name string, private_ip string, public_ip string, "
                    "status string")
# fixed values: header lines the id-list reader skips (compared case-insensitively)
ID_LIST_HEADERS = ("id,ip", "id\tip")


def with_first_line_flag(lines: DataFrame, out: str = "is_first") -> DataFrame:
    """Add ``out`` = the line is the first line of its file (needs ``file, block, seq`` straight
    from ``scan_log_lines``).

    A split is read by one task, in file order, so a file's first line is the one with the least ``seq`` of its
    offset-0 split: one partial aggregate per file, of two numbers. Those numbers, one per file (less
    than the file list that the driver holds for the scan), are broadcast back; lines are neither shuffled nor
    sent to Python.
    """
    first = lines.where(F.col("block") == 0).groupBy("file").agg(F.min("seq").alias("_first")).select("_first")
    return lines.join(F.broadcast(first), F.col("seq") == F.col("_first"), "left") \
        .withColumn(out, F.col("_first").isNotNull()).drop("_first")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` (a file, a folder or a glob) names anything: Spark's own lookup, which
    lists no more than the path itself."""
    try:
        spark.read.format("text").option("pathGlobFilter", "").load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Instance TSV written by SNK-2; the ``N/A`` sentinel becomes NULL."""
    df = (spark.read.option("sep", "\t").option("header", True).schema(INVENTORY_SCHEMA)
          .option("enforceSchema", True).csv(path))
    return df.withColumn("public_ip", F.when(F.col("public_ip") == NA, None).otherwise(F.col("public_ip")))


def read_addresses(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: ``id, ip``. The first line of each file is always skipped; each other line
    is stripped and split on tabs; fewer than 2 fields -> skipped, fields past 2 ignored.
    A blank first line is skipped like any other. A path that does not exist gives no row.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], "id string, ip string")
    lines = with_first_line_flag(scan_log_lines(spark, path)).where("not is_first")
    parts = F.split(py_strip("value"), "\t", -1)
    return (lines.select(parts.alias("p")).where(F.size("p") >= 2)
            .select(F.col("p")[0].alias("id"), F.col("p")[1].alias("ip")))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: ``id`` per non-blank line.

    A first line equal to ``id,ip`` or ``id<TAB>ip`` (any case, after strip) is a
    header. id = text before the first tab if the line has one, else before the
    first comma, else the whole line; stripped.
    """
    lines = with_first_line_flag(scan_log_lines(spark, path))
    t = py_strip("value")
    header = F.col("is_first") & F.lower(t).isin(*ID_LIST_HEADERS)
    raw = (F.when(t.contains("\t"), F.substring_index(t, "\t", 1))
           .when(t.contains(","), F.substring_index(t, ",", 1)).otherwise(t))
    return lines.where((t != "") & ~header).select(py_strip(raw).alias("id"))


def read_nodes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-6: (nodes ``hostname, public_ip, server_id, private_ip``, malformed ``line``).

    Whitespace-split; exactly 4 fields -> node; other non-blank lines -> malformed.
    A path that does not exist gives no row on either side.
    """
    df = spark.read.format("text").load(path) if path_exists(spark, path) else spark.createDataFrame([], "value string")
    p = df.select("value", py_split("value").alias("p"))
    nodes = p.where(F.size("p") == 4).select(
        F.col("p")[0].alias("hostname"), F.col("p")[1].alias("public_ip"),
        F.col("p")[2].alias("server_id"), F.col("p")[3].alias("private_ip"))
    malformed = p.where((F.size("p") > 0) & (F.size("p") != 4)).select(py_strip("value").alias("line"))
    return nodes, malformed
