"""Queries for the fleet-inventory operators (joins, tallies, projections, filters, order)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitelens.functions import columns as C
from suitelens.operators import inventory as inv
from suitelens.session import table


def s(c):
    return F.col(c).cast("string")


# ------------------------------------------------------------ shared inputs

def customer_instances(spark, sf_dir) -> DataFrame:
    """Customers as instances: eip_id = nation, own public IP only for rich accounts."""
    c = table(spark, sf_dir, "customer")
    own = F.when(F.col("c_acctbal") > 5000,
                 F.concat(F.lit("10.0."), s("c_nationkey"), F.lit("."), (F.col("c_custkey") % 250).cast("string")))
    return c.select("c_custkey", F.col("c_nationkey").alias("eip_id"), own.alias("public_ip"))


def supplier_addresses(spark, sf_dir) -> DataFrame:
    """Suppliers as an address list (id = nation, list order = suppkey); those with a negative
    balance have no id, as a failed allocation."""
    sp = table(spark, sf_dir, "supplier")
    ip = F.concat(F.lit("198.51."), (F.col("s_suppkey") % 250).cast("string"), F.lit("."), s("s_nationkey"))
    return sp.select(F.when(F.col("s_acctbal") >= 0, F.col("s_nationkey")).alias("id"), ip.alias("ip"), F.col("s_suppkey").alias("list_pos"))


def registry_lines(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    host = F.concat(F.when(k % 3 == 0, F.lit("x")).otherwise(F.lit("")), F.lit("node-"), (k % 200).cast("string"))
    line = (F.when(F.col("c_acctbal") < 0, F.concat(F.lit("# retired "), F.col("c_name")))
            .when(F.col("c_nationkey") == 0, F.lit("   "))
            .otherwise(F.concat(F.lit("10."), s("c_nationkey"), F.lit(".0."), (k % 250).cast("string"),
                                F.lit("\t"), host, F.when(k % 7 == 0, F.lit(" ")).otherwise(F.lit("")))))
    return c.select(line.alias("line"))


def incoming_nodes(spark, sf_dir) -> DataFrame:
    """Every customer as an incoming node; only segment BUILDING has hostnames that old lines end with."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    fleet = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("node-")).otherwise(F.lit("spare-"))
    return c.select(F.concat(F.lit("192.168."), (k % 250).cast("string"), F.lit("."), s("c_nationkey"))
                    .alias("private_ip"),
                    F.concat(fleet, (k % 200).cast("string")).alias("hostname"))


def order_ok(spark, sf_dir) -> DataFrame:
    """orders with ok = the order has a line with status F."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    okk = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == "F").select("l_orderkey").distinct()
    return (o.join(okk, o.o_orderkey == okk.l_orderkey, "left")
            .withColumn("ok", F.col("l_orderkey").isNotNull()).drop("l_orderkey"))


# ------------------------------------------------------------ queries

def pair_by_position(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_name")
    right = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_name")
    return inv.pair_by_position(left, right, "nation", ["c_custkey"], ["s_suppkey"]).select(
        "nation", "pos", "c_custkey", "c_name", "s_suppkey", "s_name")


def resolve_address(spark, sf_dir):
    out = inv.resolve_public_ip(customer_instances(spark, sf_dir), supplier_addresses(spark, sf_dir))
    return out.select("c_custkey", "resolved_ip")


def registry_upsert(spark, sf_dir):
    return inv.upsert_registry(registry_lines(spark, sf_dir), incoming_nodes(spark, sf_dir))


def registry_upsert_sorted(spark, sf_dir):
    """JON-3 with "ends with any" as one sorted pass."""
    return inv.upsert_registry(registry_lines(spark, sf_dir), incoming_nodes(spark, sf_dir), sorted_pass=True)


def failed_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    done = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == "F").select("l_orderkey")
    return inv.failed_ids(o, done, "o_orderkey", "l_orderkey")


def outcome_tally(spark, sf_dir):
    return inv.tally_outcomes(order_ok(spark, sf_dir), "o_orderpriority")


def all_succeeded(spark, sf_dir):
    req = table(spark, sf_dir, "customer").select("c_custkey")
    outcomes = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "F").alias("ok"))
    return inv.all_succeeded(req, outcomes, "c_custkey", on_empty=False)


def shortfall(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    req = o.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("requested"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    created = o.join(li, o.o_orderkey == li.l_orderkey, "left_semi").select("c_custkey")
    return inv.shortfall(req, created, "c_custkey").select("c_custkey", "requested", "created", "missing",
                                                           "enough")


def count_by_kind(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("eip_id"))
    return inv.count_by_kind(c, {"instances": "*", "addresses": "eip_id"})


def named_resources(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    run, task, idx = s("c_nationkey"), F.lower("c_mktsegment"), F.col("c_custkey")
    hours = (F.col("c_custkey") % 48 + 1).cast("string")
    actor = F.regexp_replace("c_name", "Customer#", "u")
    tags = C.resource_tags(run, task, idx, hours, actor)
    return c.select(
        "c_custkey",
        C.instance_name(run, task, idx.cast("string"), hours, actor).alias("instance_name"),
        C.node_hostname(idx.cast("string"), task).alias("hostname"),
        C.user_data(C.node_hostname(idx.cast("string"), task)).alias("user_data"),
        C.cluster_hostname(idx.cast("string")).alias("cluster_hostname"),
        C.address_name(run, task, idx).alias("address_name"),
        tags["Name"].alias("tag_name"), tags["Index"].alias("tag_index"),
        tags["WarningHours"].alias("tag_hours"), tags["Actor"].alias("tag_actor"))


def expiry(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    h = F.substring("o_orderpriority", 1, 1).cast("int") * 12
    return o.select("o_orderkey", C.expiry_time(F.col("o_orderdate"), h).alias("expires_at"))


def short_command(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", C.shorten_command("text").alias("short_text"))


def durations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    # a seventh: values with all their binary digits
    return e.select("event_id", C.format_duration(F.col("value") / 7).alias("duration"))


def run_stamps(spark, sf_dir):
    """The stamp of a run that starts with each event."""
    return table(spark, sf_dir, "events").select("event_id", C.run_stamp(F.col("ts").cast("timestamp")).alias("stamp"))


def log_sizes(spark, sf_dir):
    """Sizes as shown, of logs of 4099 bytes per character of a document."""
    return table(spark, sf_dir, "documents").select("doc_id", C.megabytes(F.col("n_chars") * 4099).alias("size"))


def supplier_networks(spark, sf_dir) -> DataFrame:
    """Each supplier as a server with three ordered networks and an optional explicit public IP."""
    sp = table(spark, sf_dir, "supplier")
    k, nk = F.col("s_suppkey"), s("s_nationkey")
    tail = F.concat(nk, F.lit("."), (k % 250).cast("string"))
    e = lambda addr, kind: F.struct(addr.alias("addr"), F.lit(kind).alias("ip_type"))
    net = lambda name, *entries: F.struct(F.lit(name).alias("network"), F.array(*entries).alias("entries"))
    networks = F.array(
        net("net-a", e(F.when(F.col("s_acctbal") < 0, F.lit("")).otherwise(F.concat(F.lit("192.168."), tail)), "fixed"),
            e(F.concat(F.lit("10.1."), tail), "floating")),
        net("net-b", e(F.when(k % 3 == 0, F.concat(F.lit("100.64."), tail)), "floating"),
            e(F.concat(F.lit("172.16."), tail), "fixed")),
        net("net-c", e(F.concat(F.lit("198.18."), tail), "fixed")))
    explicit = F.when(k % 5 == 0, F.concat(F.lit("203.0.113."), (k % 250).cast("string"))).when(k % 7 == 0, F.lit(""))
    return sp.select("s_suppkey", networks.alias("networks"), explicit.alias("publicip"))


def address_classes(spark, sf_dir):
    return inv.classify_addresses(supplier_networks(spark, sf_dir)).select("s_suppkey", "private_ip", "public_ip")


def addressable(spark, sf_dir):
    sp = table(spark, sf_dir, "supplier")
    pub = (F.when(F.col("s_acctbal") < 0, F.lit(inv.NA)).when(F.col("s_acctbal") < 1000, F.lit(None))
           .otherwise(F.concat(F.lit("203.0.113."), (F.col("s_suppkey") % 250).cast("string"))))
    return inv.addressable(sp.select("s_suppkey", pub.alias("public_ip")))


def drop_node_lines(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k, seg = F.col("c_custkey"), F.lower("c_mktsegment")
    n = (k % 50).cast("string")
    host = (F.when(k % 4 == 0, F.concat(F.lit("node"), n, F.lit("-"), seg))
            .when(k % 4 == 1, F.concat(F.lit("xnode"), n, F.lit("-"), seg))
            .when(k % 4 == 2, F.concat(F.lit("node"), n, F.lit("-"), seg, F.lit("x")))
            .otherwise(F.concat(F.lit("node-"), n)))
    lines = c.select("c_custkey", F.concat(F.lit("10.9.0."), n, F.lit(" "), host).alias("line"))
    return inv.drop_node_lines(lines, "building")


def line_jobs(spark, sf_dir) -> DataFrame:
    """One deletion job per order line with two sub-jobs (server, volume): the nesting
    comes from the row itself, so no group is ever collected."""
    li = table(spark, sf_dir, "lineitem")
    r, o = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    sub = lambda fail, kind, reason: F.struct(
        F.when(fail, F.lit("FAIL")).otherwise(F.lit("SUCCESS")).alias("status"), F.lit(kind).alias("type"),
        F.when(fail, reason).alias("fail_reason"))
    jobs = F.array(sub(r, "server", F.concat(F.lit("returned on "), day)),
                   sub(o, "volume", F.concat(F.lit("volume busy since "), day)))
    job_id = F.concat(s("l_orderkey"), F.lit("-"), s("l_linenumber"))
    return li.select(job_id.alias("job_id"), jobs.alias("sub_jobs"))


def failed_sub_jobs(spark, sf_dir):
    return inv.failed_sub_jobs(line_jobs(spark, sf_dir))


def first_prefix(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    host = F.concat(F.lit("node"), (F.col("c_custkey") % 20).cast("string"), F.lit("-"), F.lower("c_mktsegment"))
    rows = c.select("c_nationkey", "c_custkey", host.alias("hostname"))
    runs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return inv.first_with_prefix(rows, "c_nationkey", "hostname", "node0-", "c_custkey", runs)


def numbered_listing(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name", "c_acctbal")
    return inv.numbered_listing(c, "c_nationkey", ["c_custkey"])


QUERIES = {
    "pair_by_position": pair_by_position,
    "resolve_address": resolve_address,
    "registry_upsert": registry_upsert,
    "registry_upsert_sorted": registry_upsert_sorted,
    "failed_ids": failed_ids,
    "outcome_tally": outcome_tally,
    "all_succeeded": all_succeeded,
    "shortfall": shortfall,
    "count_by_kind": count_by_kind,
    "named_resources": named_resources,
    "expiry": expiry,
    "short_command": short_command,
    "durations": durations,
    "run_stamps": run_stamps,
    "log_sizes": log_sizes,
    "address_classes": address_classes,
    "addressable": addressable,
    "drop_node_lines": drop_node_lines,
    "failed_sub_jobs": failed_sub_jobs,
    "first_prefix": first_prefix,
    "numbered_listing": numbered_listing,
}

_REG = """
reg AS (SELECT CASE WHEN c_acctbal < 0 THEN '# retired ' || c_name
                    WHEN c_nationkey = 0 THEN '   '
                    ELSE '10.' || c_nationkey || '.0.' || (c_custkey % 250) || chr(9)
                         || CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '' END || 'node-' || (c_custkey % 200)
                         || CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE '' END END AS line
        FROM customer),
inc AS (SELECT '192.168.' || (c_custkey % 250) || '.' || c_nationkey AS private_ip,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'node-' ELSE 'spare-' END || (c_custkey % 200) AS hostname
        FROM customer),
old AS (SELECT line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM reg)
"""

_TAIL = "(s_nationkey || '.' || (s_suppkey % 250))"

ORACLES = {
    "pair_by_position": """
WITH l AS (SELECT c_nationkey AS nation, c_custkey, c_name,
                  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos FROM customer),
r AS (SELECT s_nationkey AS nation, s_suppkey, s_name,
             row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS pos FROM supplier)
SELECT l.nation, l.pos, c_custkey, c_name, s_suppkey, s_name FROM l LEFT JOIN r ON l.nation = r.nation AND l.pos = r.pos
""",
    "resolve_address": """
WITH a AS (SELECT s_nationkey AS id, arg_min('198.51.' || (s_suppkey % 250) || '.' || s_nationkey, s_suppkey) AS ip
           FROM supplier WHERE s_acctbal >= 0 GROUP BY s_nationkey)
SELECT c_custkey, coalesce(ip, CASE WHEN c_acctbal > 5000 THEN '10.0.' || c_nationkey || '.' || (c_custkey % 250) END,
                           'N/A') AS resolved_ip
FROM customer LEFT JOIN a ON c_nationkey = a.id
""",
    "registry_upsert": "WITH " + _REG + """
SELECT line, 'kept' AS source FROM old
WHERE t <> '' AND NOT starts_with(t, '#')
  AND NOT EXISTS (SELECT 1 FROM inc WHERE suffix(old.t, inc.hostname))
UNION ALL
SELECT private_ip || chr(9) || hostname, 'new' FROM inc
""",
    "failed_ids": """
SELECT o_orderkey, o_orderpriority FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')
""",
    "outcome_tally": """
WITH o AS (SELECT o_orderpriority,
                  EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') AS ok
           FROM orders)
SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE ok) AS succeeded,
       count(*) FILTER (WHERE NOT ok) AS failed
FROM o GROUP BY o_orderpriority
""",
    "all_succeeded": """
SELECT c_custkey, coalesce(bool_and(o_orderstatus = 'F'), false) AS all_ok
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""",
    "shortfall": """
WITH req AS (SELECT o_custkey AS c_custkey, count(*) AS requested FROM orders GROUP BY 1),
cr AS (SELECT o_custkey AS c_custkey, count(*) AS created FROM orders
       WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1)
SELECT req.c_custkey, requested, coalesce(created, 0) AS created,
       requested - coalesce(created, 0) AS missing, coalesce(created, 0) >= requested AS enough
FROM req LEFT JOIN cr ON req.c_custkey = cr.c_custkey
""",
    "count_by_kind": """
SELECT 'instances' AS kind, count(*) AS n FROM customer
UNION ALL
SELECT 'addresses', count(CASE WHEN c_acctbal > 0 THEN c_custkey END) FROM customer
""",
    "named_resources": """
WITH c AS (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS run, lower(c_mktsegment) AS task,
                  CAST(c_custkey % 48 + 1 AS VARCHAR) AS hours, replace(c_name, 'Customer#', 'u') AS actor
           FROM customer)
SELECT c_custkey,
       run || '-' || task || '-node' || c_custkey || '-timeout' || hours || '-' || actor AS instance_name,
       'node' || c_custkey || '-' || task AS hostname,
       to_base64(encode('#cloud-config' || chr(10) || 'hostname: node' || c_custkey || '-' || task)) AS user_data,
       'node-' || c_custkey AS cluster_hostname,
       run || '_' || task || '_' || (c_custkey + 1) AS address_name,
       run || '-' || task AS tag_name, CAST(c_custkey AS VARCHAR) AS tag_index, hours AS tag_hours,
       actor AS tag_actor
FROM c
""",
    "expiry": """
SELECT o_orderkey,
       strftime(o_orderdate + to_hours(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 12),
                '%Y-%m-%dT%H:%M:%SZ') AS expires_at
FROM orders
""",
    "short_command": """
SELECT doc_id, CASE WHEN length(text) < 60 THEN text
                    ELSE substring(text, 1, 50) || '...[truncated]...' || substring(text, length(text) - 4, 5)
               END AS short_text
FROM documents
""",
    "run_stamps": "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events",
    "log_sizes": "SELECT doc_id, printf('%.2f MB', n_chars * 4099 / 1048576.0) AS size FROM documents",
    "durations": """
SELECT event_id, printf('%dm %.2fs', CAST(floor(value / 7 / 60) AS BIGINT), fmod(value / 7, 60.0)) AS duration
FROM events
""",
    "address_classes": f"""
WITH w AS (SELECT s_suppkey, s_acctbal < 0 AS neg, s_suppkey % 3 = 0 AS b_float,
                  s_suppkey % 5 = 0 AS explicit, s_suppkey % 7 = 0 AS no_ip, {_TAIL} AS tail FROM supplier)
SELECT s_suppkey,
       CASE WHEN NOT neg AND b_float THEN '192.168.' || tail
            WHEN NOT neg AND NOT b_float THEN '198.18.' || tail
            WHEN neg AND b_float THEN '198.18.' || tail
            ELSE '172.16.' || tail END AS private_ip,
       CASE WHEN explicit THEN '203.0.113.' || (s_suppkey % 250)
            WHEN no_ip THEN 'N/A'
            WHEN NOT neg AND b_float THEN '100.64.' || tail
            WHEN NOT neg AND NOT b_float THEN 'N/A'
            WHEN neg AND b_float THEN '100.64.' || tail
            ELSE '10.1.' || tail END AS public_ip
FROM w
""",
    "addressable": """
SELECT s_suppkey, public_ip FROM (
  SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'N/A' WHEN s_acctbal < 1000 THEN NULL
                         ELSE '203.0.113.' || (s_suppkey % 250) END AS public_ip FROM supplier)
WHERE public_ip IS DISTINCT FROM 'N/A'
""",
    "drop_node_lines": """
SELECT c_custkey, line FROM (
  SELECT c_custkey, '10.9.0.' || (c_custkey % 50) || ' ' ||
         CASE c_custkey % 4 WHEN 0 THEN 'node' || (c_custkey % 50) || '-' || lower(c_mktsegment)
                            WHEN 1 THEN 'xnode' || (c_custkey % 50) || '-' || lower(c_mktsegment)
                            WHEN 2 THEN 'node' || (c_custkey % 50) || '-' || lower(c_mktsegment) || 'x'
                            ELSE 'node-' || (c_custkey % 50) END AS line
  FROM customer)
WHERE NOT regexp_matches(line, '\\b(node\\d+-building)\\b')
""",
    "failed_sub_jobs": """
SELECT l_orderkey || '-' || l_linenumber AS job_id, 'server' AS type,
       'returned on ' || strftime(l_shipdate, '%Y-%m-%d') AS fail_reason
FROM lineitem WHERE l_returnflag = 'R'
UNION ALL
SELECT l_orderkey || '-' || l_linenumber, 'volume', 'volume busy since ' || strftime(l_shipdate, '%Y-%m-%d')
FROM lineitem WHERE l_linestatus = 'O'
""",
    "first_prefix": """
WITH c AS (SELECT c_nationkey, c_custkey, 'node' || (c_custkey % 20) || '-' || lower(c_mktsegment) AS hostname
           FROM customer),
f AS (SELECT c_nationkey, arg_min(hostname, c_custkey) AS first_hostname, min(c_custkey) AS first_c_custkey
      FROM c WHERE starts_with(hostname, 'node0-') GROUP BY c_nationkey)
SELECT n_nationkey AS c_nationkey, first_hostname, first_c_custkey
FROM nation LEFT JOIN f ON n_nationkey = f.c_nationkey
""",
    "numbered_listing": """
SELECT c_nationkey, c_custkey, c_name, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS no
FROM customer
""",
}
ORACLES["registry_upsert_sorted"] = ORACLES["registry_upsert"]
