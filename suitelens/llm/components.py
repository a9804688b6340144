"""Connected components as Spark joins: alternating large and small stars.

Each round links every node's larger neighbours, then its smaller ones, to the least
node that it knows. Rounds end when the links are stars: every node is linked to one
node, the least of its component, which is linked to none. Only minima per node are aggregated, so a node may have any
number of links. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitelens.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that a link to another one touches; the root is the
    least node of the component."""
    now = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "links")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "links")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        now = stored(large.join(small, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        roots = now.select(F.col("v").alias("u")).distinct()
        # every node has one link, and to a node that has none: stars, one for each component
        one = now.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").unionByName(
            roots.join(now.select("u"), "u", "left_semi").withColumn("n", F.lit(0).cast("long"))).isEmpty()
        if one:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")) \
                .unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))
