"""Deterministic changefeeds made from the test tables: messages as a topic would deliver them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.functions.model import ColumnSpec, ReplicaSpec, StreamSpec, Strategy, TableSpec

DAY_MS = 86_400_000
#: In these feeds a message's offset is its batch times this, plus its place in the batch.
BATCH = 1_000_000_000_000
LATE_MS = 2 * DAY_MS

USERS = TableSpec("users", ("user_id",), (ColumnSpec("user_id", "Int64", False), ColumnSpec("last_type", "Utf8"), ColumnSpec("last_value", "Int64"), ColumnSpec("props", "Json")))
ORDERS = TableSpec("orders", ("o_orderkey",), (ColumnSpec("o_orderkey", "Int64", False), ColumnSpec("status", "Utf8"), ColumnSpec("total", "Int64"), ColumnSpec("priority", "Utf8")))
LINES = TableSpec("lines", ("l_orderkey", "l_linenumber"), (ColumnSpec("l_orderkey", "Int64", False), ColumnSpec("l_linenumber", "Int32", False), ColumnSpec("qty", "Int64"), ColumnSpec("price", "Int64"), ColumnSpec("flag", "Utf8")))

EVENTS_FEED = ReplicaSpec("main", (StreamSpec("events_cdc", 0, 3, USERS, Strategy.CONTINUE),))
SALES_FEED = ReplicaSpec("main", (StreamSpec("orders_cdc", 1, 2, ORDERS), StreamSpec("lines_cdc", 2, 4, LINES)))


def _millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def _pair(step: Column, tx: Column) -> Column:
    return F.array(step.cast("bigint"), tx.cast("bigint"))


def _cents(x: str) -> Column:
    return F.round(F.col(x) * 100).cast("bigint")


def _heartbeats(spark: SparkSession, topic: str, partitions: int, batches: int, step: Column, silent: Column) -> DataFrame:
    """One heartbeat a batch and partition, after all changes of the batch; ``step`` and ``silent`` see batch and partition."""
    grid = spark.range(batches).select(F.col("id").alias("batch"), F.explode(F.sequence(F.lit(0), F.lit(partitions - 1)).cast("array<bigint>")).alias("partition"))
    return grid.filter(~silent).select(
        F.lit(topic).alias("topic"),
        "partition",
        (F.col("batch") * BATCH + BATCH - 1).alias("offset"),
        "batch",
        F.to_json(F.struct(_pair(step, F.lit(0)).alias("resolved"))).alias("value"),
    )


def _message(topic: str, partition: Column, batch: Column, place: Column, value: Column) -> list[Column]:
    return [F.lit(topic).alias("topic"), partition.cast("bigint").alias("partition"), (batch * BATCH + place).alias("offset"), batch.alias("batch"), value.alias("value")]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed of one table over three partitions; every 97th change comes two days late, a partition skips heartbeats."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    batch = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint")
    step = _millis(F.col("ts")) - F.when(F.col("event_id") % 97 == 0, LATE_MS).otherwise(0)
    kind, full = F.col("event_type"), F.col("event_type").isin("purchase", "signup")
    cols = F.struct(kind.alias("last_type"), F.when(kind != "view", _cents("value")).alias("last_value"), F.when(full, F.col("props")).alias("props"))
    envelope = F.struct(
        F.when(kind == "signup", F.struct(kind.alias("last_type"), F.lit(None).cast("bigint").alias("last_value"), F.lit(None).cast("string").alias("props"))).when(kind != "error", cols).alias("update"),
        F.when(kind == "signup", cols).alias("newImage"),
        F.when(kind == "error", F.create_map().cast("map<string,string>")).alias("erase"),
        F.array("user_id").alias("key"),
        _pair(step, F.col("event_id")).alias("ts"),
    )
    changes = rows.select(*_message("events_cdc", F.col("user_id") % 3, batch, F.col("event_id"), F.to_json(envelope)))
    last = rows.agg(F.max(batch)).first()[0]
    beat = (F.unix_millis(F.lit("2024-01-01").cast("timestamp")) + (F.col("batch") + 1) * DAY_MS - F.col("partition") * 3_600_000).cast("bigint")
    silent = (F.col("partition") == 2) & (F.col("batch") % 5 == 4)
    return changes.union(_heartbeats(spark, "events_cdc", 3, 0 if last is None else last + 1, beat, silent))


MONTHS = 96


def _month(step: Column) -> Column:
    at = F.timestamp_millis(step)
    return ((F.year(at) - 1995) * 12 + F.month(at) - 1).cast("bigint")


def _month_end(lag_days: Column) -> Column:
    first = F.add_months(F.lit("1995-01-01").cast("date"), (F.col("batch") + 1).cast("int"))
    return (F.unix_date(first).cast("bigint") - lag_days) * DAY_MS


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed of two tables, orders and lines, with composite keys, erases and months as batches."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    extra = F.when(F.col("o_orderstatus") == "P", F.array(F.lit(0), F.lit(1))).when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 10 == 0), F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    o = o.withColumn("nth", F.explode(extra)).withColumn("step", _millis(F.col("o_orderdate")) + F.col("nth").cast("bigint") * (15 * DAY_MS)).withColumn("batch", _month(F.col("step")))
    full = F.col("nth") == 0
    cols = F.struct(F.when(full, F.col("o_orderstatus")).otherwise("C").alias("status"), F.when(full, _cents("o_totalprice")).alias("total"), F.when(full, F.col("o_orderpriority")).alias("priority"))
    envelope = F.struct(
        F.when(F.col("nth") < 2, cols).alias("update"),
        F.when(F.col("nth") == 2, F.create_map().cast("map<string,string>")).alias("erase"),
        F.array("o_orderkey").alias("key"),
        _pair(F.col("step"), F.col("o_orderkey")).alias("ts"),
    )
    orders = o.select(*_message("orders_cdc", F.col("o_orderkey") % 2, F.col("batch"), F.col("o_orderkey") * 3 + F.col("nth"), F.to_json(envelope)))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    li = li.withColumn("step", _millis(F.col("l_shipdate"))).withColumn("batch", _month(F.col("step")))
    gone = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 3 == 0)
    cols = F.struct(F.round("l_quantity").cast("bigint").alias("qty"), _cents("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"))
    envelope = F.struct(
        F.when(~gone, cols).alias("update"),
        F.when(gone, F.create_map().cast("map<string,string>")).alias("erase"),
        F.array(F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")).alias("key"),
        _pair(F.col("step"), F.col("l_orderkey")).alias("ts"),
    )
    lines = li.select(*_message("lines_cdc", F.col("l_orderkey") % 4, F.col("batch"), F.col("l_partkey") * 100_000 + F.col("l_suppkey"), F.to_json(envelope)))
    never = F.lit(False)
    beats = _heartbeats(spark, "orders_cdc", 2, MONTHS, _month_end(F.lit(0)), never).union(_heartbeats(spark, "lines_cdc", 4, MONTHS, _month_end(F.when(F.col("partition") == 3, 1).otherwise(0)), never))
    return orders.union(lines).union(beats)


def from_topic(spark: SparkSession, options: dict[str, str], bounded: bool = True) -> DataFrame:
    """MESSAGE rows from a topic source (needs the source's package on the class path).

    ``failOnDataLoss`` stays on unless the options say otherwise: offsets that the topic no longer holds stop the query instead of
    being skipped. A topic knows no micro-batches; ``batch`` is 0, and the streaming replica numbers them itself.
    """
    reader = spark.read if bounded else spark.readStream
    return as_messages(reader.format("kafka").options(**{"failOnDataLoss": "true"} | options).load())


def as_messages(rows: DataFrame) -> DataFrame:
    """A topic source's rows as MESSAGE rows; a column ``batch`` is taken over if there is one."""
    batch = F.col("batch").cast("bigint") if "batch" in rows.columns else F.lit(0).cast("bigint")
    return rows.select("topic", F.col("partition").cast("bigint").alias("partition"), F.col("offset").cast("bigint").alias("offset"), batch.alias("batch"), F.col("value").cast("string").alias("value"))


def from_files(spark: SparkSession, path: str, files_per_batch: int | None = None, bounded: bool = True) -> DataFrame:
    """Messages from Parquet files of MESSAGE rows, the files being the micro-batches of a stream."""
    from ebbflow.functions.model import MESSAGE

    if bounded:
        return spark.read.schema(MESSAGE).parquet(path)
    reader = spark.readStream.schema(MESSAGE)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
