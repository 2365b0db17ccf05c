"""Heartbeats: the latest of each partition, and the position below which every partition is complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.functions.model import ReplicaSpec, position, zero

CELLS = 4096


def layout(spark, replica: ReplicaSpec) -> DataFrame:
    """(topic, stream_id, partition): every partition that must send heartbeats."""
    rows = [(s.topic, s.stream_id, s.partitions) for s in replica.streams]
    return spark.createDataFrame(rows, "topic string, stream_id int, n bigint").select("topic", "stream_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("partition"))


def observed_layout(log: DataFrame) -> DataFrame:
    """Partitions seen by topic."""
    return log.groupBy("topic").agg(F.countDistinct("partition").alias("partitions"))


def last_heartbeat(heartbeats: DataFrame) -> DataFrame:
    """The greatest heartbeat of each partition; older ones that come later don't count."""
    return heartbeats.groupBy("stream_id", "partition").agg(F.max(position()).alias("hb"))


def quorum(latest: DataFrame, total: int) -> DataFrame:
    """One row: heartbeats (partitions that have one), ready, quorum (least; null unless ready), furthest (greatest)."""
    n = F.count(F.lit(1))
    return latest.agg(
        n.alias("heartbeats"),
        (n == total).alias("ready"),
        F.when(n == total, F.min("hb")).alias("quorum"),
        F.max("hb").alias("furthest"),
    )


def quorum_after(found: DataFrame, at: Column) -> DataFrame:
    """The quorum only if it lies beyond ``at``."""
    return found.withColumn("quorum", F.when(F.col("quorum") > at, F.col("quorum")))


def missing(latest: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected partitions without heartbeat."""
    return expected.join(latest.select("stream_id", "partition"), ["stream_id", "partition"], "left_anti")


def schedule(heartbeats: DataFrame, replica: ReplicaSpec, last_batch: int) -> DataFrame:
    """(batch, quorum, checkpoint) for every batch up to ``last_batch``.

    A batch's quorum is the least of its partitions' greatest heartbeats so far, null until all partitions have one. Its
    checkpoint is the quorum of the batch before, the zero position at first.
    """
    spark = heartbeats.sparkSession
    seen = heartbeats.groupBy("batch", "stream_id", "partition").agg(F.max(position()).alias("hb"))
    grid = layout(spark, replica).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(last_batch)).cast("array<bigint>")))
    so_far = Window.partitionBy("stream_id", "partition").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(seen, ["batch", "stream_id", "partition"], "left").withColumn("hb", F.max("hb").over(so_far))
    by_batch = filled.groupBy("batch").agg(F.when(F.count("hb") == replica.partitions, F.min("hb")).alias("quorum"))
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    return by_batch.select("batch", "quorum", F.coalesce(F.max("quorum").over(before), zero()).alias("checkpoint"))


def advancing(plan: DataFrame) -> DataFrame:
    """The batches whose quorum lies beyond the checkpoint: those that apply something."""
    return plan.filter("quorum > checkpoint")


def apply_batch(changes: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``apply_batch``: the first batch from a change's own on whose quorum lies beyond it; null if none does yet.

    Quorums never fall, so they cut the positions into ranges. The ranges are spread over equal cells of the step axis
    and matched to changes by cell, which shuffles or broadcasts at the optimiser's choice and needs no nested loop.
    """
    cuts = advancing(plan).select("batch", "quorum", F.col("checkpoint").alias("since"))
    low, high = cuts.agg(F.min("quorum.step"), F.max("quorum.step")).first()
    if high is None:
        return changes.withColumn("apply_batch", F.lit(None).cast("bigint"))
    low, high = int(low), int(high)
    width = max(1, -(-(high - low + 1) // CELLS))
    # Steps below the first quorum share the first cell.
    cell = lambda step: F.floor((F.greatest(step, F.lit(low).cast("decimal(20,0)")) - low) / width).cast("bigint")
    ranges = cuts.withColumn("cell", F.explode(F.sequence(cell(F.col("since.step")), cell(F.col("quorum.step"))))).select("cell", "batch", "quorum", "since")
    ranges = ranges.withColumnsRenamed({"batch": "reached", "quorum": "until", "cell": "of"})
    at = position()
    placed = changes.withColumn("cell", cell(F.col("step"))).join(ranges, (F.col("cell") == F.col("of")) & (at >= F.col("since")) & (at < F.col("until")), "left")
    return placed.withColumn("apply_batch", F.when(F.col("reached").isNotNull(), F.greatest("batch", "reached"))).drop("cell", "of", "reached", "until", "since")
