"""Many changes of a key to one net operation, and its cells.

Changes carry a typed key (columns named by the table's key), ``cols``, ``kind``, a position, an arrival number
(``offset``) and the batch that applies them (``apply_batch``).

Two modes. ``reference``: batches are folded one after another; an erase clears what the batch had gathered so far, and
if an update follows it in the same batch, cells that the update doesn't name keep the destination's old values.
``exact``: an erase anywhere before an update removes those values as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.model import TableSpec
from ebbflow.functions.parse import column_set

REFERENCE, EXACT = "reference", "exact"


def order() -> Column:
    """What decides which of two changes of a key comes later."""
    return F.struct("apply_batch", "step", "tx_id", "offset")


def net_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, op): the last operation of each key."""
    return changes.groupBy(*keys).agg(F.max_by("kind", order()).alias("op"))


def _winners(changes: DataFrame, keys: list[str], columns: list[str], batches: bool) -> DataFrame:
    """By key (and batch): the last operation, the last erase, and for each column the last update that names it.

    One aggregation with a partial step before the shuffle, so a key with any number of changes leaves a task as one row.
    Its buffers hold strings, so Spark sorts for it; that sort is within a task, and nothing is joined back.
    """
    at = order()
    erased = F.when(F.col("kind") == "erase", at)
    wrote = [
        F.max(F.when((F.col("kind") == "update") & F.coalesce(F.map_contains_key("cols", F.lit(c)), F.lit(False)), F.struct(at.alias("at"), F.col("cols")[c].alias("value")))).alias(f"w{i}")
        for i, c in enumerate(columns)
    ]
    by = [*keys, "apply_batch"] if batches else keys
    return changes.groupBy(*by).agg(F.max(F.struct(at.alias("at"), F.col("kind").alias("kind")))["kind"].alias("last"), F.max(erased).alias("erased_at"), *wrote)


def folded(changes: DataFrame, table: TableSpec, mode: str = REFERENCE) -> DataFrame:
    """(keys, op, keeps_base, cols): the net operation of each key, whether cells without a write keep the old values, and the written cells.

    A cell counts if its last write comes after the last erase that could clear it. In ``reference`` mode that is the last
    erase of the write's own batch, and the last batch that ends in an erase; no earlier write can count if the last one doesn't.
    """
    keys, columns = list(table.key), [c.name for c in table.values]
    if mode == EXACT:
        net = _winners(changes, keys, columns, False)
        clear, alive = F.col("erased_at"), lambda w: w["at"] > F.col("erased_at")
        net = net.withColumnRenamed("last", "op")
    else:
        one = _winners(changes, keys, columns, True)
        kept = [F.max(F.when((F.col("last") == "update") & (F.col("erased_at").isNull() | (F.col(f"w{i}.at") > F.col("erased_at"))), F.col(f"w{i}"))).alias(f"w{i}") for i in range(len(columns))]
        net = one.groupBy(*keys).agg(
            F.max(F.struct("apply_batch", "last"))["last"].alias("op"),
            F.max(F.when(F.col("last") == "erase", F.col("apply_batch"))).alias("gone_batch"),
            *kept,
        )
        clear, alive = F.col("gone_batch"), lambda w: w["at"]["apply_batch"] > F.col("gone_batch")
    cells = [F.when(F.col(f"w{i}").isNotNull() & (clear.isNull() | alive(F.col(f"w{i}"))), F.struct(F.lit(c).alias("key"), F.col(f"w{i}.value").alias("value"))) for i, c in enumerate(columns)]
    cols = F.map_from_entries(F.array_compact(F.array(*cells))) if cells else F.create_map().cast("map<string,string>")
    return net.select(*keys, "op", clear.isNull().alias("keeps_base"), F.when(F.col("op") == "update", cols).alias("cols"))


def cells(changes: DataFrame, table: TableSpec, mode: str = REFERENCE) -> DataFrame:
    """(keys, column, value): what the updates leave written in each cell of the keys that end in an update."""
    return folded(changes, table, mode).select(*table.key, F.explode("cols").alias("column", "value"))


def column_sets(changes: DataFrame) -> DataFrame:
    """(column_set, n): changes by the set of columns that they write."""
    return changes.filter("kind = 'update'").groupBy(column_set().alias("column_set")).agg(F.count(F.lit(1)).alias("n"))


def modification_counts(changes: DataFrame) -> DataFrame:
    """Changes (not folded) by table."""
    return changes.groupBy("table").agg(F.count(F.lit(1)).alias("n"))


def request_bytes(changes: DataFrame) -> DataFrame:
    """Payload bytes by stream: what an apply step carries."""
    return changes.groupBy("stream_id").agg(F.sum(F.octet_length("value").cast("bigint")).alias("bytes"))
