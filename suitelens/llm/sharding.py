"""Sharding by balanced label propagation.

Documents with equal texts are linked (through their group, so a group of n copies
has n links and not n * n). Every document starts in a shard dealt by its id. In each
round the groups count their members per shard and name a home: of the shards in which the whole
group has room the one with most of its members, else one drawn in proportion to the
room that is left. A group larger than a shard names as many shards as its rows need. The
other members move there as far as there is room; of groups that lie whole in a shard with
too many rows, some look for another. Rounds end when nobody wants to move and no shard has too many rows, or
after ``rounds`` of them. At the end rows above a
shard's quota, documents without links first, move to shards below theirs, which makes
the counts equal to within one.

Nothing is ever gathered per group beyond one count per shard, so a group may hold
any part of all rows. Rounds are joins on the group's digest against at most
``shards`` rows per group; flows between shards are tables of at most ``shards`` rows.

Defined cases: a null text counts no bytes and forms one group with other null texts;
repeated rows (also of one id) are rows of their own; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suitelens.llm.common import prepare, stored
from suitelens.operators.ranking import grouped_row_number

#: bytes that a row counts besides its text
ROW_BYTES = 16


def _unit(*cols: Column) -> Column:
    """A number from 0 up to 1, the same for equal values."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def shard_documents(docs: DataFrame, shards: int = 40, rounds: int = 12, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, group, shard, slot`` for every row of ``docs``; shard
    counts differ by one at most, slots run from 0 in each shard."""
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit(""))).alias("group"))
    rows = stored(base.withColumn("rid", F.monotonically_increasing_id()), "shard-rows")
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    room = max(1, total // shards)

    groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    linked = (rows.join(groups, "group").select(
        "rid", "group", "n", F.pmod(F.xxhash64("doc_id", "rid"), F.lit(shards)).cast("int").alias("shard")))
    linked = stored(linked, "shard-labels")
    for k in range(rounds):
        moved = _round(linked, shards, room, k)
        if moved is None:
            break
        linked = stored(moved, "shard-labels")

    labels = linked.select("rid", F.col("shard").alias("_to"))
    placed = rows.join(labels, "rid", "left").select(
        "rid", "doc_id", "size", "text_crc32", "group", F.col("_to").isNull().alias("single"),
        F.coalesce("_to", F.pmod(F.xxhash64("doc_id", "rid"), F.lit(shards)).cast("int")).alias("shard"))
    numbered = grouped_row_number(placed, ["shard"], ["single", "group", "rid"], out="rn")
    return _even(numbered, shards, quotas)


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _round(linked: DataFrame, shards: int, room: int, k: int) -> DataFrame | None:
    """One step of propagation; None when no document wants to move."""
    found = {r["shard"]: r for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("n") <= room).alias("small")).collect()}
    free = [room - (found[s]["c"] if s in found else 0) for s in range(shards)]
    small = [found[s]["small"] if s in found else 0 for s in range(shards)]
    counts = linked.groupBy("group", "n", "shard").agg(F.count(F.lit(1)).alias("c"))
    hot = F.col("n") > room
    # a group that is whole stays, but for a share of those in a shard with too many rows
    above, inside = (F.get(_longs(x), F.col("shard")) for x in ([max(0, -f) for f in free], small))
    leaving = F.when(above > 0, F.greatest(above, F.col("n")) / inside).otherwise(0.0)
    whole = (F.col("c") == F.col("n")) & (_unit(F.col("group"), F.lit("stay"), F.lit(k)) >= leaving)
    fits = whole | ((F.col("c") < F.col("n")) & (F.get(_longs(free), F.col("shard")) + F.col("c") >= F.col("n")))
    by_count = Window.partitionBy("group").orderBy(F.desc("c"), F.xxhash64("group", "shard"))
    ranked = counts.filter(hot | fits).withColumn("_r", F.row_number().over(by_count))
    homes = (ranked.filter(F.col("_r") <= F.when(hot, F.ceil(F.col("n") / F.lit(room))).otherwise(1))
             .groupBy("group").agg(F.sort_array(F.collect_list("shard")).alias("homes")))  # at most `shards` entries
    # for a group without a home: a shard drawn by the room that is left, or the one with most of it
    begins, total = [], 0
    for f in free:
        begins.append(total)
        total += max(0, f)
    at = (_unit(F.col("group"), F.lit("draw"), F.lit(k)) * F.lit(float(total))).cast("long")
    open_shards = [s for s in range(shards) if free[s] > 0]
    drawn = F.get(F.array(*[F.lit(s) for s in open_shards]), F.size(F.filter(_longs([begins[s] for s in open_shards]), lambda b: b <= at)) - 1) \
        if open_shards else F.col("shard")
    roomiest = max(range(shards), key=lambda s: free[s])
    drawn = F.when(F.get(_longs(free), drawn) >= F.col("n"), drawn).when(F.col("n") <= free[roomiest], F.lit(roomiest)).otherwise(F.col("shard"))
    wish = linked.join(homes, "group", "left").withColumn(
        "to", F.when(F.col("homes").isNull(), drawn)
        .when(F.array_contains("homes", F.col("shard")), F.col("shard"))
        .otherwise(F.get("homes", F.pmod(F.xxhash64("rid"), F.size("homes")).cast("int"))))
    wish = stored(wish.drop("homes"), "shard-wishes")
    flows = wish.groupBy("to").agg(F.sum(F.when(F.col("to") == F.col("shard"), 1).otherwise(0)).alias("stay"),
                                   F.sum(F.when(F.col("to") != F.col("shard"), 1).otherwise(0)).alias("come")).collect()
    leave = {r["shard"]: r["c"] for r in wish.filter(F.col("to") != F.col("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("c")).collect()}
    if not leave and not (max(free) > 0 and any(f < 0 < n for f, n in zip(free, small))):
        return None
    part = [1.0] * shards  # of those who want to come, as many as there is room for
    for r in flows:
        free = room - r["stay"]
        part[r["to"]] = max(0.0, min(1.0, free / max(1, r["come"])))
    allowed = F.get(F.array(*[F.lit(p) for p in part]), F.col("to"))
    moves = (F.col("to") == F.col("shard")) | (_unit(F.col("group"), F.lit(k)) < allowed) | \
        ((F.col("n") > room) & (_unit(F.col("rid"), F.lit(k)) < allowed))
    return wish.select("rid", "group", "n", F.when(moves, F.col("to")).otherwise(F.col("shard")).alias("shard"))


def _even(numbered: DataFrame, shards: int, quotas: list[int]) -> DataFrame:
    """Move the rows above each shard's quota into the free slots of the others."""
    have = dict.fromkeys(range(shards), 0)
    have |= {r["shard"]: r["c"] for r in numbered.groupBy("shard").agg(F.count(F.lit(1)).alias("c")).collect()}
    over, seen = [], 0
    for s in range(shards):
        over.append(seen)
        seen += max(0, have[s] - quotas[s])
    gap_begin, gap_shard, gap_slot, seen = [], [], [], 0
    for s in range(shards):
        if have[s] < quotas[s]:
            gap_begin.append(seen)
            gap_shard.append(s)
            gap_slot.append(have[s])
            seen += quotas[s] - have[s]
    out = numbered.select("doc_id", "size", "text_crc32", "group", "shard", (F.col("rn") - 1).cast("long").alias("slot"))
    if not gap_begin:
        return out

    quota, before = F.get(_longs(quotas), F.col("shard")), F.get(_longs(over), F.col("shard"))
    extra = out.withColumn("_i", F.when(F.col("slot") >= quota, before + F.col("slot") - quota))
    extra = extra.withColumn("_g", F.size(F.filter(_longs(gap_begin), lambda b: b <= F.col("_i"))) - 1)
    moved = F.col("_i").isNotNull()
    return extra.select(
        "doc_id", "size", "text_crc32", "group",
        F.when(moved, F.get(_longs(gap_shard), F.col("_g"))).otherwise(F.col("shard")).cast("int").alias("shard"),
        F.when(moved, F.get(_longs(gap_slot), F.col("_g")) + F.col("_i") - F.get(_longs(gap_begin), F.col("_g")))
        .otherwise(F.col("slot")).cast("long").alias("slot"))
