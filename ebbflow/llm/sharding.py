"""Sharding by balanced label propagation: linked documents move together, shards keep equal numbers of rows.

Documents are linked when their texts are equal. A group is a star around its text's hash, so no pairs are made. Linked
documents start on shards by a hash of their id. In every round

1. the members of each group are counted by shard; the group's targets are its fullest shards, one, or for a group
   larger than a shard as many as it fills;
2. members elsewhere ask to move to a target; asks are counted by shard;
3. each shard has room for its quota less what it holds; where more ask, the share that fits is let in (small groups
   as a whole, by a hash of the group; large ones by document).

Rounds end when nothing moves, or after ``rounds``; full shards admit nothing, so rounds alone can leave groups split.
Then ``settle`` makes the rest whole: a group that lies on one shard stays if the shard's quota holds it, and all other
groups, those larger than a shard first, are laid one after the other into the places left free. A group is cut only
where a shard's free places end, so at most ``shards`` - 1 groups that a shard could hold are cut, however full the shards are. All unlinked
documents take the places after them. So the law is ``rows``: the counts of any two shards differ by one at most.

Only tables with a row a shard reach the driver. Ranks within a shard or over all rows are taken within hash buckets and
carried over the buckets, so no task holds a shard, a group or the whole table.

Defined results: a null text counts as the empty text and is linked with empty ones; repeated rows get slots of their own; rows with a null id
are placed like any other; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbflow.llm import support

SHARDS, ROUNDS = 40, 8
OVERHEAD = 16
ORDER = ("h", "doc_id", "size", "text_crc32", "g")
ROW = ("doc_id", "size", "text_crc32", "g", "h")


def _ranked(rows: DataFrame, keys: list[str], buckets: int, name: str) -> DataFrame:
    """Adds ``name``: the row's place (from 0) within its keys."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(53), "h"), F.lit(buckets)))
    counts = rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("there"))
    within = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = counts.select(*keys, "bucket", (F.sum("there").over(within) - F.col("there")).alias("before"))
    place = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*ORDER))
    return rows.withColumn("nth", place).join(before, [*keys, "bucket"]).withColumn(name, F.col("before") + F.col("nth") - 1).drop("bucket", "nth", "before")


def _pick(values: list, shard: Column) -> Column:
    """The value of a shard from a list with one for each."""
    return F.element_at(F.array(*map(F.lit, values)), (shard + 1).cast("int"))


def _counts(rows: DataFrame, column: str, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in rows.groupBy(column).count().collect()}
    return [found.get(s, 0) for s in range(shards)]


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.lit(47), text).alias("g"),
        F.xxhash64(F.lit(51), F.col(id_col)).alias("h"),
    )
    base = support.checkpoint(base)
    n = base.count()
    buckets = support.power_of_two(math.sqrt(n))
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    groups = base.groupBy("g").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    linked = support.checkpoint(base.join(groups, "g").withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")))
    linked = propagate(linked, quotas, rounds)

    fixed, moved, ahead = settle(linked, quotas, buckets)
    kept = _counts(fixed, "shard", shards)
    ends, at = [], 0
    for quota, k in zip(quotas, kept):
        at += quota - k
        ends.append(at)
    # Groups without a shard, then all unlinked rows, fill the shards with room.
    loose = _ranked(base.join(groups, "g", "left_anti").select(*ROW), [], buckets, "place").withColumn("place", F.col("place") + ahead)
    filled = moved.select(*ROW, "place").union(loose.select(*ROW, "place"))
    filled = filled.withColumn("shard", F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("place"))).cast("int"))
    every = fixed.select(*ROW, "shard").union(filled.select(*ROW, "shard"))
    every = support.checkpoint(every)
    return _ranked(every, ["shard"], buckets, "slot").select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _starts(groups: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Adds ``start``: the members of the groups (g, members) before this one within its keys."""
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64(F.lit(55), "g"), F.lit(buckets)))
    within = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = groups.groupBy(*keys, "bucket").agg(F.sum("members").alias("there")).select(*keys, "bucket", (F.sum("there").over(within) - F.col("there")).alias("before"))
    here = F.sum("members").over(Window.partitionBy(*keys, "bucket").orderBy("g").rowsBetween(Window.unboundedPreceding, 0))
    return groups.withColumn("here", here).join(before, [*keys, "bucket"]).withColumn("start", F.col("before") + F.col("here") - F.col("members")).drop("bucket", "here", "before")


def settle(linked: DataFrame, quotas: list[int], buckets: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows whose whole group stays on its shard; all others with a ``place`` that keeps groups together; their number."""
    counted = linked.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("k"), F.first("members").alias("members"))
    whole = counted.filter(F.col("k") == F.col("members")).select("g", "shard", "members")
    stay = _starts(whole, ["shard"], buckets).filter(F.col("start") + F.col("members") <= _pick(quotas, F.col("shard"))).select("g")
    stay = support.checkpoint(stay)
    fixed = linked.join(stay, "g", "left_semi")
    left = linked.join(stay, "g", "left_anti")
    rest = left.groupBy("g").agg(F.count(F.lit(1)).alias("members")).withColumn("small", (F.col("members") <= min(quotas)).cast("int"))
    rest = support.checkpoint(_starts(rest, ["small"], buckets))
    total = {r["small"]: r["n"] for r in rest.groupBy("small").agg(F.sum("members").alias("n")).collect()}
    first = rest.select("g", (F.col("start") + F.when(F.col("small") == 1, total.get(0, 0)).otherwise(0)).alias("start"))
    moved = _ranked(left.drop("members", "shard"), ["g"], buckets, "nth_of").join(first, "g").withColumn("place", F.col("start") + F.col("nth_of"))
    return fixed, support.checkpoint(moved.select(*ROW, "place")), sum(total.values())


def propagate(linked: DataFrame, quotas: list[int], rounds: int) -> DataFrame:
    """Rounds of moves of (doc_id, size, text_crc32, g, h, members, shard) towards the shards of their groups."""
    shards = len(quotas)
    room_of_one = max(1, min(quotas))
    for turn in range(rounds):
        load = _counts(linked, "shard", shards)
        room = [max(0, q - k) for q, k in zip(quotas, load)]
        # Full shards stay targets of the groups that they hold, but take no more.
        counted = linked.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("k"), F.first("members").alias("members"))
        tie = F.xxhash64(F.lit(turn), "g", "shard")
        ranked = counted.groupBy("g").agg(F.sort_array(F.collect_list(F.struct(F.col("k"), tie.alias("tie"), F.col("shard"))), asc=False).alias("at"), F.first("members").alias("members"))
        many = F.greatest(F.lit(1), F.ceil(F.col("members") / room_of_one)).cast("int")
        targets = ranked.select(F.col("g").alias("of"), F.transform(F.slice("at", 1, many), lambda x: x["shard"]).alias("targets"))
        asking = linked.join(targets, linked["g"] == targets["of"]).withColumn(
            "ask",
            F.when(F.array_contains("targets", F.col("shard")), F.lit(None)).otherwise(F.element_at("targets", (F.pmod(F.xxhash64(F.lit(turn + 61), "h"), F.size("targets")) + 1).cast("int"))),
        )
        asking = support.checkpoint(asking.drop("of", "targets"))
        asks = _counts(asking.filter("ask is not null"), "ask", shards)
        if not any(asks):
            return linked
        # Each shard lets in the share that fits.
        share = [1.0 if a <= r else 0.97 * r / a for a, r in zip(asks, room)]
        unit = F.when(F.col("members") > room_of_one, F.xxhash64(F.lit(turn + 67), "h")).otherwise(F.xxhash64(F.lit(turn + 71), "g", "shard"))
        let_in = F.pmod(unit, F.lit(1 << 30)) < _pick(share, F.col("ask")) * (1 << 30)
        linked = support.checkpoint(asking.withColumn("shard", F.when(F.col("ask").isNotNull() & let_in, F.col("ask")).otherwise(F.col("shard"))).drop("ask"))
    return linked


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards."""
    return shard(support.table(spark, sf_dir, "documents"))
