"""Messages to log rows: classification, changes, heartbeats, keys.

A message is a JSON object. ``update`` or ``erase`` make a change (with ``key`` and ``ts``), ``resolved`` makes a
heartbeat; ``newImage`` alone makes nothing. What can't be parsed becomes a row of kind ``malformed`` with the reason in ``error``; no row is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.model import UINT64, UINT64_MAX, ReplicaSpec

ENVELOPE = f"struct<update:map<string,string>,newImage:map<string,string>,erase:map<string,string>,key:string,ts:array<{UINT64}>,resolved:array<{UINT64}>>"


def _in_range(pair: Column) -> Column:
    return F.forall(pair, lambda x: x.isNotNull() & (x >= 0) & (x <= F.lit(str(UINT64_MAX)).cast(UINT64)))


def parse(messages: DataFrame, replica: ReplicaSpec) -> DataFrame:
    """Log rows: the message's own columns and stream_id, kind, step, tx_id, key, key_json, cols, error.

    ``cols`` maps each column of the change to its JSON text (strings without quotes); a null value is an explicit
    JSON null. A non-empty ``newImage`` takes the place of ``update``. A message is read once; its key, small, once more.
    """
    # A generator keeps the optimiser from copying the parse into every expression and filter that reads its result.
    rows = messages.withColumn("m", F.explode(F.array(F.from_json("value", ENVELOPE))))
    rows = rows.withColumn("k", F.from_json("m.key", "array<string>"))
    update, image, erase, ts, resolved = (F.col(f"m.{n}") for n in ("update", "newImage", "erase", "ts", "resolved"))
    writes = update.isNotNull()
    change = writes | erase.isNotNull()
    error = (
        F.when(change & writes & erase.isNotNull(), "both update and erase")
        .when(change & (ts.isNull() | (F.size(ts) != 2)), "ts needs two numbers")
        .when(change & ~_in_range(ts), "ts out of range")
        .when(change & F.col("k").isNull(), "no key")
        .when(change, F.lit(None))
        .when(resolved.isNotNull() & (F.size(resolved) != 2), "resolved needs two numbers")
        .when(resolved.isNotNull() & ~_in_range(resolved), "resolved out of range")
        .when(resolved.isNotNull(), F.lit(None))
        .otherwise("unknown format")
    )
    rows = rows.withColumn("error", error)
    good = F.col("error").isNull()
    at = F.when(good, F.when(change, ts).otherwise(resolved))
    stream = F.lit(None).cast("int")
    for s in replica.streams:
        stream = F.when(F.col("topic") == s.topic, F.lit(s.stream_id)).otherwise(stream)
    return rows.select(
        *messages.columns,
        stream.alias("stream_id"),
        F.when(~good, "malformed").when(erase.isNotNull() & change, "erase").when(change, "update").otherwise("resolved").alias("kind"),
        F.element_at(at, 1).alias("step"),
        F.element_at(at, 2).alias("tx_id"),
        F.when(good & change, F.col("k")).alias("key"),
        F.when(good & change, F.col("m.key")).alias("key_json"),
        F.when(good & change & erase.isNull(), F.when(F.size(image) > 0, image).otherwise(update)).alias("cols"),
        "error",
    )


def changes(log: DataFrame) -> DataFrame:
    return log.filter(F.col("kind").isin("update", "erase"))


def heartbeats(log: DataFrame) -> DataFrame:
    return log.filter("kind = 'resolved'")


def route(log: DataFrame, replica: ReplicaSpec) -> dict[str, DataFrame]:
    """The changes of each destination table."""
    return {s.table.name: changes(log).filter(F.col("stream_id") == s.stream_id) for s in replica.streams}


def table_name(replica: ReplicaSpec) -> Column:
    """The destination table of a row's stream."""
    found = F.lit("")
    for s in replica.streams:
        found = F.when(F.col("stream_id") == s.stream_id, s.table.name).otherwise(found)
    return found


def filter_key(path: str | Column, key: str = "key", separated: bool = False) -> Column:
    """The binary key of the blocked-key set: byte 1, the table's path, the key's raw values one after another.

    Without separator, as stored sets have it, keys such as [1, 23] and [12, 3] coincide; ``separated`` puts a zero byte
    before each value instead.
    """
    path = F.lit(path) if isinstance(path, str) else path
    joined = F.array_join(F.transform(key, lambda k: F.concat(F.lit("\0"), k)), "") if separated else F.array_join(key, "")
    return F.concat(F.unhex(F.lit("01")), path.cast("binary"), joined.cast("binary"))


def column_set(cols: str = "cols") -> Column:
    """The signature of a change's columns: quoted names in order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(cols)), lambda c: F.concat(F.lit("`"), c, F.lit("`"))), ", ")
