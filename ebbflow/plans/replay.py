"""Bounded replay: a whole log applied in one plan, without a loop over its batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.functions import convert, parse
from ebbflow.functions.model import ReplicaSpec, TableSpec, position
from ebbflow.operators import apply, fold, order, quorum
from ebbflow.shared import checkpoint


@dataclass
class Replayed:
    """The tables after the log, what still waits, what didn't fit its table (with ``violation``), and the batches with their quorums."""

    tables: dict[str, DataFrame]
    pending: DataFrame
    rejected: DataFrame
    plan: DataFrame

    def checkpoint(self) -> DataFrame:
        """(step, tx_id): the last quorum, or nothing."""
        return self.plan.agg(F.max("quorum").alias("q")).select(F.col("q.step").alias("step"), F.col("q.tx_id").alias("tx_id"))


def keyed(changes: DataFrame, table: TableSpec) -> DataFrame:
    """The changes with the table's key columns."""
    keys = [convert.convert(F.get(F.col("key"), F.lit(i)), table.column(n).type).alias(n) for i, n in enumerate(table.key)]
    return changes.select("*", *keys)


def typed(changes: DataFrame, table: TableSpec) -> DataFrame:
    """The changes that fit the table, with its key columns."""
    return keyed(convert.fitting(changes, table), table)


def placed(log: DataFrame, replica: ReplicaSpec, last_batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(changes that aren't stale, with their apply batch and ``violation``; the plan).

    Messages are dear to parse, and the plan must be known before changes can be placed: the log's parsed columns are written once, and
    everything else reads them.
    """
    wanted = [c for c in log.columns if c not in ("value", "error")]
    log = checkpoint(log.select(*wanted).filter("kind <> 'malformed'"))
    if last_batch is None:
        last_batch = log.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
    plan = checkpoint(quorum.schedule(parse.heartbeats(log), replica, last_batch))
    known = plan.select(F.col("batch").alias("in_batch"), F.col("checkpoint"))
    fresh = parse.changes(log).join(known, F.col("batch") == F.col("in_batch")).filter(position() >= F.col("checkpoint")).drop("in_batch", "checkpoint")
    misfit = F.coalesce(*(F.when(F.col("stream_id") == s.stream_id, convert.violation(s.table)) for s in replica.streams))
    return quorum.apply_batch(fresh, plan).withColumn("violation", misfit), plan


def replay(log: DataFrame, replica: ReplicaSpec, base: dict[str, DataFrame] | None = None, mode: str = fold.REFERENCE, blocked: DataFrame | None = None, last_batch: int | None = None) -> Replayed:
    """Applies a parsed log whose rows carry their micro-batch number.

    Late changes (``order.out_of_order``) are the caller's to take out first; ``rejected`` is the caller's to judge.
    """
    spark = log.sparkSession
    rows, plan = placed(log, replica, last_batch)
    if blocked is not None:
        rows = order.without_blocked(rows.withColumn("filter_key", parse.filter_key(parse.table_name(replica))), blocked).drop("filter_key")
    ready = rows.filter("apply_batch is not null and violation is null")
    tables = {}
    for s in replica.streams:
        own = keyed(ready.filter(F.col("stream_id") == s.stream_id), s.table)
        start = (base or {}).get(s.table.name)
        tables[s.table.name] = apply.apply_net(apply.empty(spark, s.table) if start is None else start, fold.folded(own, s.table, mode), s.table)
    return Replayed(tables, rows.filter("apply_batch is null and violation is null").drop("violation"), rows.filter("violation is not null"), plan)
