"""The replica's state row and its lease, as pure functions of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.model import ReplicationHalted, Stage

STATE = "id string, step_id decimal(20,0), tx_id decimal(20,0), state string, stage string, last_msg string, lock_owner string, lock_deadline timestamp"


def init(states: DataFrame, instances: DataFrame) -> DataFrame:
    """The states and a first row for every instance (column ``id``) that has none."""
    new = instances.select("id").distinct().join(states.select("id"), "id", "left_anti")
    first = new.select(
        "id",
        F.lit(0).cast("decimal(20,0)").alias("step_id"),
        F.lit(0).cast("decimal(20,0)").alias("tx_id"),
        F.lit("OK").alias("state"),
        F.lit(Stage.INITIAL_SCAN.value).alias("stage"),
        F.lit(None).cast("string").alias("last_msg"),
        F.lit("").alias("lock_owner"),
        F.lit(None).cast("timestamp").alias("lock_deadline"),
    )
    return states.unionByName(first)


def problem() -> Column:
    """Why a state row doesn't let its replica run, or null."""
    return (
        F.when(F.col("state").isNull(), "no state")
        .when(F.col("state") != "OK", F.concat(F.lit("state is "), F.col("state"), F.lit(": "), F.coalesce("last_msg", F.lit(""))))
        .when(F.col("step_id").isNull() | F.col("tx_id").isNull(), "no position")
        .when(F.col("stage").isNull(), "no stage")
    )


def lookup(states: DataFrame, instance: str):
    """The one state row of an instance that may run."""
    found = states.filter(F.col("id") == instance).withColumn("problem", problem()).take(2)
    if len(found) != 1:
        raise ReplicationHalted(f"{len(found)} state rows for {instance}")
    if found[0]["problem"]:
        raise ReplicationHalted(f"{instance}: {found[0]['problem']}")
    return found[0]


def checkpoint(states: DataFrame, done: DataFrame) -> DataFrame:
    """The states with the positions and stages of ``done`` (id, step_id, tx_id, stage); other fields stay."""
    new = done.select(F.col("id").alias("of"), F.col("step_id").alias("new_step"), F.col("tx_id").alias("new_tx"), F.col("stage").alias("new_stage"))
    joined = states.join(new, F.col("id") == F.col("of"), "left")
    take = F.col("of").isNotNull()
    return joined.withColumns({"step_id": F.when(take, F.col("new_step")).otherwise(F.col("step_id")), "tx_id": F.when(take, F.col("new_tx")).otherwise(F.col("tx_id")), "stage": F.when(take, F.col("new_stage")).otherwise(F.col("stage"))}).drop("of", "new_step", "new_tx", "new_stage")


def lease(owner: Column, deadline: Column, me: Column, now: Column, ttl_ms: Column) -> tuple[Column, Column]:
    """(owner, deadline) in milliseconds after ``me`` asked: renewed if held, taken if free or expired, else unchanged."""
    mine = (owner == me) | F.coalesce(deadline <= now, F.lit(True))
    return F.when(mine, me).otherwise(owner), F.when(mine, now + ttl_ms).otherwise(deadline)
