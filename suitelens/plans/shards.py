"""Queries for shard selection: suite_commands (JON-4), shard_assignment and shard_cover (JON-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suitelens.operators import shards
from suitelens.session import table

# Rule templates for the parts-as-suites queries (a parameter, not reference data):
# per module: two included-brand shards and a remainder shard that excludes both;
# module "standard" runs whole; "economy" gets one extra overlapping shard.
BRANDS_A = [f"Brand#{i}" for i in range(1, 9)]
BRANDS_B = [f"Brand#{i}" for i in range(9, 17)]
OVERLAP = ["Brand#8", "Brand#9"]


def task_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks for one of the 31 shards (by user); error events use the asan- prefix."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    names = F.array(*[F.lit(s) for s in shards.ALL_SHARDS])
    base = F.element_at(names, (F.pmod(F.col("user_id"), F.lit(len(shards.ALL_SHARDS))) + 1).cast("int"))
    task = F.when(F.col("event_type") == "error", F.concat(F.lit(shards.ASAN_PREFIX), base)).otherwise(base)
    return ev.select("event_id", task.alias("task"))


def suite_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.select_suite_command(task_requests(spark, sf_dir), "task",
                                      strip_prefix=shards.ASAN_PREFIX)
    return out.select("event_id", "task", "module",
                      F.array_join("included", ",").alias("included_tags"),
                      F.array_join("excluded", ",").alias("excluded_tags"), "command")


def part_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return p.select(F.col("p_partkey").alias("suite"), F.lower("p_type").alias("module"),
                    F.array("p_brand", "p_type").alias("tags"))


def part_rules(suites: DataFrame) -> DataFrame:
    """Rules per distinct module, built by exploding templates (no join)."""
    m = F.col("module")
    lit_arr = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    rule = lambda name, inc, exc: F.struct(name.alias("task"), inc.alias("included"), exc.alias("excluded"))
    normal = F.array(rule(F.concat(m, F.lit("-1")), lit_arr(BRANDS_A), lit_arr([])),
                     rule(F.concat(m, F.lit("-2")), lit_arr(BRANDS_B), lit_arr([])),
                     rule(F.concat(m, F.lit("-3")), lit_arr([]), lit_arr(BRANDS_A + BRANDS_B)))
    templates = (F.when(m == "standard", F.array(rule(m, lit_arr([]), lit_arr([]))))
                 .when(m == "economy", F.concat(normal, F.array(rule(F.lit("economy-x"), lit_arr(OVERLAP),
                                                                     lit_arr([])))))
                 .otherwise(normal))
    mods = suites.select("module").distinct()
    return mods.select("module", F.explode(templates).alias("r")).select(
        F.col("r.task").alias("task"), "module", F.col("r.included").alias("included"),
        F.col("r.excluded").alias("excluded"))


def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = part_suites(spark, sf_dir)
    return shards.assign_shards(s, part_rules(s))


def shard_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = part_suites(spark, sf_dir)
    return shards.shard_cover_check(s, part_rules(s))


QUERIES = {
    "suite_commands": suite_commands,
    "shard_assignment": shard_assignment,
    "shard_cover": shard_cover,
}


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]::VARCHAR[]"


def _rules_values() -> str:
    rows = []
    for t, m, inc, exc in shards.NAMED_SHARDS:
        rows.append(f"('{t}', '{m}', {_sql_list([shards.TAG_PREFIX + x for x in inc])}, "
                    f"{_sql_list([shards.TAG_PREFIX + x for x in exc])})")
    return ",\n".join(rows)


def _opt(flag: str, col: str) -> str:
    return (f"CASE WHEN len({col}) = 0 THEN '' WHEN len({col}) = 1 THEN ' --{flag} ' || {col}[1] "
            f"ELSE ' --{flag} \"' || array_to_string({col}, ',') || '\"' END")


_SUITES_RULES = f"""
s AS (SELECT p_partkey AS suite, lower(p_type) AS module, [p_brand, p_type] AS tags FROM part),
types AS (SELECT DISTINCT lower(p_type) AS m FROM part),
rules AS (
  SELECT m || '-1' AS shard, m AS rmodule, {_sql_list(BRANDS_A)} AS inc, []::VARCHAR[] AS exc FROM types WHERE m <> 'standard'
  UNION ALL SELECT m || '-2', m, {_sql_list(BRANDS_B)}, []::VARCHAR[] FROM types WHERE m <> 'standard'
  UNION ALL SELECT m || '-3', m, []::VARCHAR[], {_sql_list(BRANDS_A + BRANDS_B)} FROM types WHERE m <> 'standard'
  UNION ALL SELECT 'economy-x', m, {_sql_list(OVERLAP)}, []::VARCHAR[] FROM types WHERE m = 'economy'
  UNION ALL SELECT m, m, []::VARCHAR[], []::VARCHAR[] FROM types WHERE m = 'standard'),
a AS (SELECT suite, module, shard FROM s JOIN rules ON module = rmodule AND (
        (len(inc) = 0 AND len(exc) = 0)
        OR (len(inc) > 0 AND list_has_any(tags, inc))
        OR (len(inc) = 0 AND len(exc) > 0 AND NOT list_has_any(tags, exc))))
"""

ORACLES = {
    "suite_commands": f"""
WITH rules(rtask, rmodule, inc, exc) AS (VALUES
{_rules_values()}),
t AS (SELECT event_id,
             CASE WHEN event_type = 'error' THEN 'asan-' ELSE '' END
               || ({_sql_list(shards.ALL_SHARDS)})[((user_id % {len(shards.ALL_SHARDS)}) + {len(shards.ALL_SHARDS)}) % {len(shards.ALL_SHARDS)} + 1] AS task
      FROM events),
k AS (SELECT event_id, task, CASE WHEN starts_with(task, 'asan-') THEN substr(task, 6) ELSE task END AS base FROM t),
j AS (SELECT event_id, task, coalesce(rmodule, base) AS module,
             coalesce(inc, []::VARCHAR[]) AS inc, coalesce(exc, []::VARCHAR[]) AS exc
      FROM k LEFT JOIN rules ON base = rtask)
SELECT event_id, task, module, array_to_string(inc, ',') AS included_tags,
       array_to_string(exc, ',') AS excluded_tags,
       '{shards.RUN_TESTS}' || module || {_opt('included-tags', 'inc')} || {_opt('excluded-tags', 'exc')} AS command
FROM j
""",
    "shard_assignment": "WITH " + _SUITES_RULES + "SELECT suite, module, shard FROM a",
    "shard_cover": "WITH " + _SUITES_RULES + """,
c AS (SELECT suite, count(*) AS n FROM a GROUP BY suite)
SELECT s.suite, s.module, coalesce(n, 0) AS n_shards FROM s LEFT JOIN c ON s.suite = c.suite
WHERE coalesce(n, 0) <> 1
""",
}
