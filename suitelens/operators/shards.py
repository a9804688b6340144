"""Test-shard selection: JON-4 select_suite_command and JON-5 assign_shards.

A shard rule is ``task -> (module, included tags, excluded tags)``. An empty
array means "no tags" (never NULL: NULL would make the overlap predicate NULL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suitelens.operators.util import maybe_broadcast

TAG_PREFIX = "org.apache.spark.tags."

# fixed values: the named shard rules, as task, module, included tags, excluded tags
# (tags without the "org.apache.spark.tags." prefix)
NAMED_SHARDS = (
    ("hive-1", "hive", ("HivePartOneTest", "HivePartTwoTest"), ()),
    ("hive-2", "hive", ("SlowHiveTest",), ()),
    ("hive-3", "hive", (), ("HivePartOneTest", "HivePartTwoTest", "SlowHiveTest")),
    ("hive-thriftserver-1", "hive-thriftserver", ("HiveThriftServerPartOneTest",), ()),
    ("hive-thriftserver-2", "hive-thriftserver", ("HiveThriftServerPartTwoTest",), ()),
    ("hive-thriftserver-3", "hive-thriftserver", ("HiveThriftServerPartThreeTest",), ()),
    ("hive-thriftserver-4", "hive-thriftserver", ("HiveThriftServerPartFourTest",), ()),
    ("hive-thriftserver-5", "hive-thriftserver", (), ("HiveThriftServerPartOneTest", "HiveThriftServerPartTwoTest",
                                                      "HiveThriftServerPartThreeTest", "HiveThriftServerPartFourTest")),
    ("sql-a-1", "sql", ("ExtendedSQLPartOneTest",), ()),
    ("sql-a-2", "sql", ("ExtendedSQLPartTwoTest",), ()),
    ("sql-a-3", "sql", ("ExtendedSQLPartThreeTest",), ()),
    ("sql-a-4", "sql", ("ExtendedSQLPartFourTest",), ()),
    ("sql-a-5", "sql", ("ExtendedSQLPartFiveTest",), ()),
    ("sql-a-6", "sql", ("ExtendedSQLPartSixTest",), ()),
    ("sql-a-7", "sql", ("ExtendedSQLPartZeroTest",), ()),
    ("sql-b-1", "sql", ("SlowSQLPartOneTest",), ()),
    ("sql-b-2", "sql", ("SlowSQLPartTwoTest",), ()),
    ("sql-c-1", "sql", ("SplitSQLPartOneTest",), ()),
    ("sql-c-2", "sql", ("SplitSQLPartTwoTest",), ()),
    ("sql-c-3", "sql", ("SplitSQLPartThreeTest",), ()),
    ("sql-c-4", "sql", ("SplitSQLPartFourTest",), ()),
    ("sql-c-5", "sql", (), ("ExtendedSQLPartOneTest", "ExtendedSQLPartTwoTest", "ExtendedSQLPartThreeTest",
                            "ExtendedSQLPartFourTest", "ExtendedSQLPartFiveTest", "SlowSQLPartOneTest",
                            "SlowSQLPartTwoTest", "SplitSQLPartOneTest", "SplitSQLPartTwoTest",
                            "SplitSQLPartThreeTest", "SplitSQLPartFourTest", "ExtendedSQLPartZeroTest",
                            "ExtendedSQLPartSixTest")),
)

# fixed values: the 31 shards of a full suite run
ALL_SHARDS = (
    "kubernetes", "streaming", "catalyst", "hive-thriftserver-1", "hive-thriftserver-2",
    "hive-thriftserver-3", "hive-thriftserver-4", "hive-thriftserver-5", "sql-kafka-0-10",
    "streaming-kafka-0-10", "mesos", "yarn", "hadoop-cloud", "connect", "hive-1", "hive-2", "hive-3",
    "sql-a-1", "sql-a-2", "sql-a-3", "sql-a-4", "sql-a-5", "sql-a-6", "sql-a-7", "sql-b-1", "sql-b-2",
    "sql-c-1", "sql-c-2", "sql-c-3", "sql-c-4", "sql-c-5",
)

# fixed values: command template pieces
RUN_TESTS = "./dev/run-tests --parallelism 1 --modules "
ASAN_PREFIX = "asan-"

RULE_SCHEMA = "task string, module string, included array<string>, excluded array<string>"


def named_shard_rules(spark: SparkSession) -> DataFrame:
    rows = [(t, m, [TAG_PREFIX + x for x in inc], [TAG_PREFIX + x for x in exc])
            for t, m, inc, exc in NAMED_SHARDS]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _tag_option(flag: str, tags) -> F.Column:
    """`` --included-tags a`` or `` --included-tags "a,b"``; empty when there are no tags."""
    joined = F.array_join(tags, ",")
    quoted = F.when(F.size(tags) > 1, F.concat(F.lit('"'), joined, F.lit('"'))).otherwise(joined)
    return F.when(F.size(tags) > 0, F.concat(F.lit(f" --{flag} "), quoted)).otherwise(F.lit(""))


def select_suite_command(tasks: DataFrame, task_col: str = "task", rules: DataFrame | None = None,
                         strip_prefix: str | None = None) -> DataFrame:
    """JON-4: add ``module, included, excluded, command`` for each task.

    Unknown tasks run their own name as the module with no tag selection.
    ``strip_prefix`` (e.g. ``"asan-"``) is removed from the task name first.
    """
    spark = tasks.sparkSession
    rules = rules if rules is not None else named_shard_rules(spark)
    t = F.col(task_col)
    if strip_prefix:
        t = F.when(t.startswith(strip_prefix), F.expr(f"substring(`{task_col}`, {len(strip_prefix) + 1})")) \
            .otherwise(t)
    keyed = tasks.withColumn("_task", t)
    r = maybe_broadcast(rules.select(F.col("task").alias("_rtask"), F.col("module").alias("_rmodule"),
                                     F.col("included").alias("_inc"), F.col("excluded").alias("_exc")))
    joined = keyed.join(r, keyed["_task"] == r["_rtask"], "left")
    empty = F.array().cast("array<string>")
    inc = F.coalesce(F.col("_inc"), empty)
    exc = F.coalesce(F.col("_exc"), empty)
    module = F.coalesce(F.col("_rmodule"), F.col("_task"))
    command = F.concat(F.lit(RUN_TESTS), module, _tag_option("included-tags", inc),
                       _tag_option("excluded-tags", exc))
    return (joined.withColumn("module", module).withColumn("included", inc)
            .withColumn("excluded", exc).withColumn("command", command)
            .drop("_task", "_rtask", "_rmodule", "_inc", "_exc"))


def assign_shards(suites: DataFrame, rules: DataFrame, suite_col: str = "suite",
                  tags_col: str = "tags") -> DataFrame:
    """JON-5: ``suite, module, shard`` for every rule a suite falls under.

    A rule covers a suite of its module when the rule has no tags at all, when a
    suite tag is included, or when the rule only excludes and no suite tag is
    excluded. Rules with included tags are looked up by tag: each (module, included tag) is a
    posting, and a suite meets only rules that share a tag with it. Rules without included tags
    hold for all suites of their module but those that meet an excluded tag: nearly all those pairs are
    results, so they are joined by module. Rules may be computed, so the joins' strategy is left to Spark (its
    size check, or sort-merge joins whose hot keys AQE splits), and building the query starts no job.
    """
    s, r = _suite_rows(suites, suite_col, tags_col), _rule_rows(rules)
    included = _met(s, r, "_inc")
    rest = s.join(r.where(F.size("_inc") == 0), "module").where(~F.arrays_overlap("_tags", F.array_compact("_exc")))
    return included.unionByName(rest, allowMissingColumns=True).select(F.col("suite").alias(suite_col), "module", "shard")


def _tag_set(c) -> F.Column:
    return F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))


def _suite_rows(suites: DataFrame, suite_col: str, tags_col: str) -> DataFrame:
    """``suite, module, _tags``; NULL tags are no tags."""
    return suites.select(F.col(suite_col).alias("suite"), "module", F.array_compact(_tag_set(F.col(tags_col))).alias("_tags"))


def _rule_rows(rules: DataFrame) -> DataFrame:
    """``shard, module, _inc, _exc``; a list of nothing but NULLs is still a list of tags, which no suite has."""
    return rules.select(F.col("task").alias("shard"), "module", _tag_set(F.col("included")).alias("_inc"),
                        _tag_set(F.col("excluded")).alias("_exc"))


def _met(s: DataFrame, r: DataFrame, tags: str) -> DataFrame:
    """Suites with the rules of their module of whose list ``tags`` they have a tag. A pair that shares
    several tags meets at each, and stays at the first of them."""
    postings = r.select("module", F.explode(tags).alias("_tag"), F.col(tags).alias("_list"), "shard")
    tagged = s.select("suite", "module", "_tags", F.explode("_tags").alias("_tag"))
    return (tagged.join(postings, ["module", "_tag"])
            .where(F.col("_tag") == F.get(F.array_intersect("_tags", "_list"), F.lit(0))).select("suite", "module", "shard"))


def shard_cover_check(suites: DataFrame, rules: DataFrame, suite_col: str = "suite",
                      tags_col: str = "tags") -> DataFrame:
    """Suites that land in no shard or in more than one: ``suite, module, n_shards``, counted
    over the rows of a suite.

    Counted, not paired: a suite has the rules it meets by an included tag, and those of
    its module without included tags (one number per module) less those it meets by an excluded one.
    """
    s, r = _suite_rows(suites, suite_col, tags_col), _rule_rows(rules)
    wide = r.where(F.size("_inc") == 0)
    of_module = wide.groupBy("module").agg(F.count(F.lit(1)).alias("_all"))

    def each(df: DataFrame, n) -> DataFrame:
        return df.select("suite", "module", n.cast("long").alias("_n"))

    parts = (each(s.join(of_module, "module", "left"), F.coalesce("_all", F.lit(0)))
             .unionByName(each(_met(s, r, "_inc"), F.lit(1)))
             .unionByName(each(_met(s, wide, "_exc"), F.lit(-1))))
    return (parts.groupBy(F.col("suite").alias(suite_col), "module").agg(F.sum("_n").alias("n_shards"))
            .where(F.col("n_shards") != 1).select(suite_col, "module", "n_shards"))
