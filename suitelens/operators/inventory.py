"""Fleet-inventory operators.

Joins: JON-1 pair_by_position, JON-2 resolve_public_ip, JON-3 upsert_registry,
JON-6 failed_ids. Aggregates: AGG-2 tally_outcomes, AGG-3 all_succeeded,
AGG-4 shortfall, AGG-5 count_by_kind. Filters: FLT-3 addressable, FLT-4
drop_node_lines, FLT-5 failed_sub_jobs. Projection: PRJ-5 classify_addresses.
Order: ORD-3 numbered_listing, ORD-4 first_with_prefix.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitelens.functions.columns import py_strip
from suitelens.operators.ranking import grouped_row_number
from suitelens.operators.suffixes import ends_with_any

# fixed values: sentinel for a missing address, address kinds, job states
NA = "N/A"
FIXED, FLOATING = "fixed", "floating"
FAIL = "FAIL"


# ---------------------------------------------------------------- joins

def pair_by_position(left: DataFrame, right: DataFrame, run: str, left_order: list,
                     right_order: list, pos: str = "pos") -> DataFrame:
    """JON-1: the i-th left row of a run gets the i-th right row of the same run (or NULLs).

    Both sides are numbered with the skew-safe ``grouped_row_number``; the join key
    (run, pos) is unique per row, so a hot run does not make a hot join key.
    """
    l_ = grouped_row_number(left, [run], left_order, pos)
    r_ = grouped_row_number(right.withColumnRenamed(run, "_rrun"), ["_rrun"], right_order, "_rpos")
    j = l_.join(r_, (F.col(run) == F.col("_rrun")) & (F.col(pos) == F.col("_rpos")), "left")
    return j.drop("_rrun", "_rpos")


def resolve_public_ip(instances: DataFrame, addresses: DataFrame, ref_col: str = "eip_id",
                      own_col: str = "public_ip", addr_id: str = "id", addr_ip: str = "ip",
                      addr_order: str = "list_pos", out: str = "resolved_ip") -> DataFrame:
    """JON-2: address by id (first in list order wins), else the instance's own IP, else N/A.

    The lookup is first reduced to one row per id with a partial aggregation (a hot id
    collapses map-side), then left-joined; Spark picks broadcast or sort-merge from size.
    """
    first = addresses.groupBy(F.col(addr_id).alias("_aid")).agg(
        F.min_by(F.col(addr_ip), F.col(addr_order)).alias("_aip"))
    j = instances.join(first, F.col(ref_col) == F.col("_aid"), "left")
    return j.withColumn(out, F.coalesce(F.col("_aip"), F.col(own_col), F.lit(NA))).drop("_aid", "_aip")


def upsert_registry(registry: DataFrame, incoming: DataFrame, line_col: str = "line",
                    ip_col: str = "private_ip", host_col: str = "hostname", sorted_pass: bool = False) -> DataFrame:
    """JON-3 + SET-1: ``line, source`` -- old lines kept, then ``ip<TAB>hostname`` per incoming row.

    An old line is dropped when it is blank, a comment, or its stripped text ends with
    any incoming hostname (so ``xnode-1`` is dropped by ``node-1``). "Ends with any" is
    evaluated as an equi-join: each distinct stripped line is expanded to its suffixes of
    those lengths that an incoming hostname has (one small array, a scalar subquery), and
    those are semi-joined with the hostnames. Building the query starts no job.

    ``sorted_pass`` takes one sorted pass over the distinct lines and hostnames instead
    (``suffixes.ends_with_any``): each of them once, whatever the number of lengths, but its rows are
    written once while the query is built. The result is the same.
    """
    t = py_strip(line_col)
    old = registry.withColumn("_t", t).where((F.col("_t") != "") & ~F.col("_t").startswith("#"))
    if sorted_pass:
        hit = ends_with_any(old.select("_t"), incoming.select(host_col)).withColumnRenamed("text", "_t")
    else:
        hosts = incoming.select(F.col(host_col).alias("_h")).where(F.col("_h").isNotNull()).distinct()
        lengths = hosts.agg(F.collect_set(F.length("_h"))).scalar()
        texts = old.select("_t").distinct().withColumn("_n", lengths)
        suffixes = texts.select("_t", F.explode(F.expr(
            "transform(filter(_n, L -> L <= length(_t)), L -> substring(_t, length(_t) - L + 1, L))")).alias("_s"))
        hit = suffixes.join(hosts, F.col("_s") == F.col("_h"), "left_semi").select("_t").distinct()
    kept = old.join(hit, "_t", "left_anti")
    new = incoming.select(F.concat_ws("\t", F.col(ip_col), F.col(host_col)).alias(line_col),
                          F.lit("new").alias("source"))
    return append_rows(kept.select(line_col, F.lit("kept").alias("source")), new)


def append_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """SET-1: concatenate by column *name* (the other side may list columns in another
    order or lack some, which become NULL). No shuffle."""
    return df.unionByName(other, allowMissingColumns=True)


def failed_ids(attempted: DataFrame, succeeded: DataFrame, key: str, succeeded_key: str | None = None
               ) -> DataFrame:
    """JON-6: attempted rows without a success (left anti join). The right side is reduced to
    distinct keys first, which combines map-side, so a hot key cannot weigh on one task."""
    sk = succeeded_key or key
    s = succeeded.select(F.col(sk).alias("_sk")).distinct()
    return attempted.join(s, F.col(key) == F.col("_sk"), "left_anti")


# ---------------------------------------------------------------- aggregates

def tally_outcomes(df: DataFrame, group, ok_col: str = "ok") -> DataFrame:
    """AGG-2: ``total, succeeded, failed`` per group (the failed ids are ``failed_ids``)."""
    keys = [group] if isinstance(group, str) else list(group)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"),
                                 F.count_if(F.col(ok_col)).alias("succeeded"),
                                 F.count_if(~F.col(ok_col)).alias("failed"))


def all_succeeded(requests: DataFrame, outcomes: DataFrame, key: str, ok_col: str = "ok",
                  on_empty: bool = True, out: str = "all_ok") -> DataFrame:
    """AGG-3: per request key, every outcome ok; a key without outcomes gets ``on_empty``."""
    agg = outcomes.groupBy(F.col(key).alias("_k")).agg(F.bool_and(ok_col).alias("_all"))
    j = requests.join(agg, F.col(key) == F.col("_k"), "left")
    return j.withColumn(out, F.coalesce(F.col("_all"), F.lit(on_empty))).drop("_k", "_all")


def shortfall(requests: DataFrame, created: DataFrame, key: str, requested_col: str = "requested"
              ) -> DataFrame:
    """AGG-4: ``created, missing, enough`` per request (created counted per key)."""
    counts = created.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
    j = requests.join(counts, F.col(key) == F.col("_k"), "left")
    c = F.coalesce(F.col("_c"), F.lit(0))
    return (j.withColumn("created", c)
            .withColumn("missing", F.col(requested_col) - c)
            .withColumn("enough", c >= F.col(requested_col))
            .drop("_k", "_c"))


def count_by_kind(df: DataFrame, kinds: dict) -> DataFrame:
    """AGG-5: ``kind, n``; ``kinds`` maps a kind name to a column counted non-null ('*' = all rows).

    One aggregation pass, then an unpivot of the single result row.
    """
    aggs = [(F.count(F.lit(1)) if c == "*" else F.count(F.col(c))).alias(f"_n{i}")
            for i, c in enumerate(kinds.values())]
    one = df.agg(*aggs)
    pairs = ", ".join(f"'{k}', _n{i}" for i, k in enumerate(kinds))
    return one.select(F.expr(f"stack({len(kinds)}, {pairs}) AS (kind, n)"))


# ---------------------------------------------------------------- filters

def addressable(df: DataFrame, col: str = "public_ip") -> DataFrame:
    """FLT-3: drop rows whose public IP is the N/A sentinel (NULL passes, as in the reference)."""
    return df.where(~F.col(col).eqNullSafe(F.lit(NA)))


def drop_node_lines(lines: DataFrame, task: str, col: str = "line") -> DataFrame:
    """FLT-4: drop lines naming a ``node<digits>-<task>`` word (task taken literally)."""
    rx = r"\b(node\d+-" + re.escape(task) + r")\b"
    return lines.where(~F.col(col).rlike(rx))


def failed_sub_jobs(jobs: DataFrame, sub_col: str = "sub_jobs", keep=("job_id",)) -> DataFrame:
    """FLT-5: one row per failed sub-job: ``*keep, type, fail_reason``."""
    return (jobs.select(*keep, F.inline(F.col(sub_col)))
            .where(F.col("status") == FAIL)
            .select(*keep, "type", "fail_reason"))


# ---------------------------------------------------------------- projections

def classify_addresses(df: DataFrame, networks_col: str = "networks", explicit_col: str | None = "publicip"
                       ) -> DataFrame:
    """PRJ-5: ``private_ip, public_ip`` from ordered networks of address entries.

    Networks are walked in order; in each only the first entry with a non-empty
    address counts (fixed -> private, floating -> public), later networks overwrite
    earlier ones until both are set. A non-null explicit public IP wins, also an empty one,
    which is no address: N/A. NULL stands for "no such attribute"; missing -> N/A.
    Pure expression (``aggregate`` over the array): no shuffle, no Python.
    """
    init = F.struct(F.lit(None).cast("string").alias("priv"), F.lit(None).cast("string").alias("pub"))

    def step(acc, net):
        first = F.get(F.filter(net["entries"], lambda e: e["addr"].isNotNull() & (e["addr"] != "")), 0)
        done = acc["priv"].isNotNull() & acc["pub"].isNotNull()
        priv = F.when(first["ip_type"] == FIXED, first["addr"]).otherwise(acc["priv"])
        pub = F.when(first["ip_type"] == FLOATING, first["addr"]).otherwise(acc["pub"])
        return F.when(done, acc).otherwise(F.struct(priv.alias("priv"), pub.alias("pub")))

    walked = F.aggregate(F.col(networks_col), init, step)
    pub = walked["pub"]
    if explicit_col is not None:
        explicit = F.col(explicit_col)
        pub = F.when(explicit == "", F.lit(NA)).otherwise(F.coalesce(explicit, pub))
    return df.withColumn("private_ip", F.coalesce(walked["priv"], F.lit(NA))) \
             .withColumn("public_ip", F.coalesce(pub, F.lit(NA)))


# ---------------------------------------------------------------- order

def numbered_listing(df: DataFrame, run: str, order: list, out: str = "no") -> DataFrame:
    """ORD-3: number rows of each run from 1 in ``order`` (skew-safe, no single-task window)."""
    return grouped_row_number(df, [run], order, out)


def first_with_prefix(df: DataFrame, run: str, col: str, prefix: str, order: str,
                      runs: DataFrame | None = None) -> DataFrame:
    """ORD-4: per run, the first row (by ``order``) whose ``col`` starts with ``prefix``.

    ``runs`` (optional) lists every run so runs without a match come out with NULL.
    Partial aggregation: a hot run is reduced map-side.
    """
    first = (df.where(F.col(col).startswith(prefix))
             .groupBy(run).agg(F.min_by(F.col(col), F.col(order)).alias("first_" + col),
                               F.min(order).alias("first_" + order)))
    if runs is None:
        return first
    return runs.join(first, run, "left")
