"""Shard selection (FIXTURES A9)."""

import random
from collections import Counter

from suitelens.operators import shards


def test_named_and_default_tasks(spark):
    tasks = spark.createDataFrame([("hive-1",), ("hive-3",), ("catalyst",), ("asan-sql-a-7",)], "task string")
    out = {r.task: r for r in shards.select_suite_command(tasks, strip_prefix="asan-").collect()}
    assert out["hive-1"].command == ('./dev/run-tests --parallelism 1 --modules hive --included-tags '
                                     '"org.apache.spark.tags.HivePartOneTest,org.apache.spark.tags.HivePartTwoTest"')
    assert out["hive-3"].included == [] and len(out["hive-3"].excluded) == 3
    assert out["catalyst"].command == "./dev/run-tests --parallelism 1 --modules catalyst"
    assert out["asan-sql-a-7"].command.endswith("--included-tags org.apache.spark.tags.ExtendedSQLPartZeroTest")


def test_rule_table_size():
    assert len(shards.NAMED_SHARDS) == 22 and len(shards.ALL_SHARDS) == 31
    assert len(shards.NAMED_SHARDS[-1][3]) == 13


def test_assign_and_cover(spark):
    suites = spark.createDataFrame(
        [("s1", "hive", ["org.apache.spark.tags.SlowHiveTest"]),
         ("s2", "hive", []),
         ("s3", "hive", ["org.apache.spark.tags.HivePartOneTest", "org.apache.spark.tags.SlowHiveTest"]),
         ("s4", "catalyst", [])],
        "suite string, module string, tags array<string>")
    rules = shards.named_shard_rules(spark).unionByName(
        spark.createDataFrame([("catalyst", "catalyst", [], [])], shards.RULE_SCHEMA))
    got = sorted((r.suite, r.shard) for r in shards.assign_shards(suites, rules).collect())
    assert got == [("s1", "hive-2"), ("s2", "hive-3"), ("s3", "hive-1"), ("s3", "hive-2"), ("s4", "catalyst")]
    cover = [(r.suite, r.n_shards) for r in shards.shard_cover_check(suites, rules).collect()]
    assert cover == [("s3", 2)]


def test_maybe_broadcast_checks_rows_and_bytes(spark):
    from suitelens.operators.util import maybe_broadcast
    small = spark.range(10)
    big_rows = spark.range(200)
    wide = spark.range(5).selectExpr("repeat('x', 1000) AS s")
    hint = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hint(maybe_broadcast(small, max_rows=100))
    assert not hint(maybe_broadcast(big_rows, max_rows=100))
    assert not hint(maybe_broadcast(wide, max_rows=100, max_bytes=1000))


def test_null_tags_do_not_hide_a_suite(spark):
    suites = spark.createDataFrame([("s", "hive", [None, "org.apache.spark.tags.Other"])],
                                   "suite string, module string, tags array<string>")
    got = [r.shard for r in shards.assign_shards(suites, shards.named_shard_rules(spark)).collect()]
    assert got == ["hive-3"]


def _covers(tags, inc, exc):
    tags, inc, exc = ({x for x in xs or []} for xs in (tags, inc, exc))
    tags.discard(None)
    return bool(tags & inc) if inc else not tags & exc


def test_rules_by_tag_like_every_pair(spark):
    rng = random.Random(5)
    names, tags = ["m1", "m2", "m3", None], ["a", "b", "c", "d", None]

    def some(k):
        return None if rng.random() < 0.1 else [rng.choice(tags) for _ in range(rng.randrange(k))]

    suites = [(f"s{rng.randrange(60)}", rng.choice(names), some(4)) for _ in range(150)]
    rules = [(f"t{rng.randrange(30)}", rng.choice(names), some(3), some(4)) for _ in range(40)]
    s = spark.createDataFrame(suites, "suite string, module string, tags array<string>")
    r = spark.createDataFrame(rules, shards.RULE_SCHEMA)
    want = sorted((n, m, t) for n, m, g in suites for t, rm, inc, exc in rules if m is not None and m == rm and _covers(g, inc, exc))
    assert sorted(tuple(x) for x in shards.assign_shards(s, r).collect()) == want
    found = Counter((n, m) for n, m, _ in want)
    cover = {(n, m): found[n, m] for n, m, _ in suites if found[n, m] != 1}
    got = {(x.suite, x.module): x.n_shards for x in shards.shard_cover_check(s, r).collect()}
    assert got == cover


def test_many_rules_of_one_module(spark):
    """100,000 rules and 2,000 suites of one module: 2e8 pairs, of which 4,000 share a tag."""
    s = spark.range(2000).selectExpr("id AS suite", "concat('m', id % 1) AS module", "array(concat('t', id), concat('t', id + 50000), 'other') AS tags")
    r = spark.range(100_000).selectExpr("concat('r', id) AS task", "concat('m', id % 1) AS module", "array(concat('t', id)) AS included",
                                        "cast(array() AS array<string>) AS excluded")
    got = shards.assign_shards(s, r)
    assert got.count() == 4000 and got.where("shard not in (concat('r', suite), concat('r', suite + 50000))").count() == 0
    cover = shards.shard_cover_check(s, r.unionByName(spark.createDataFrame([("x", "m0", [], ["other"])], shards.RULE_SCHEMA)))
    assert cover.agg({"n_shards": "sum"}).first()[0] == 4000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    met = shards._met(shards._suite_rows(s, "suite", "tags"), shards._rule_rows(r), "_inc")
    assert "_tag" in [line for line in met._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line][0]
