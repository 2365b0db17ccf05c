"""Net operations against a table's snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.convert import convert
from ebbflow.functions.model import TableSpec


def apply_deletes(base: DataFrame, keys_gone: DataFrame, table: TableSpec) -> DataFrame:
    """The snapshot without the given keys."""
    return base.join(keys_gone.select(*table.key), list(table.key), "left_anti")


def apply_net(base: DataFrame, net: DataFrame, table: TableSpec) -> DataFrame:
    """The next snapshot: a full outer join by key, cell by cell.

    A written cell takes its value, null included. Other cells keep the old value unless the key was erased before.
    Without an erase a key that the snapshot lacks starts with nulls.
    """
    keys = list(table.key)
    renamed = net.select(*(F.col(k).alias(f"n_{k}") for k in keys), "op", "keeps_base", "cols")
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(k) == F.col(f"n_{k}"))
    joined = base.join(renamed, match, "full_outer").filter("op is null or op = 'update'")
    out = []
    for c in table.columns:
        if c.name in table.key:
            out.append(F.coalesce(c.name, f"n_{c.name}").alias(c.name))
        else:
            there = F.coalesce(F.map_contains_key("cols", F.lit(c.name)), F.lit(False))
            kept = F.when(F.coalesce("keeps_base", F.lit(True)), F.col(c.name))
            out.append(F.when(there, convert(F.col("cols")[c.name], c.type)).otherwise(kept).alias(c.name))
    return joined.select(*out)


def empty(spark, table: TableSpec) -> DataFrame:
    from ebbflow.functions.convert import spark_type

    return spark.createDataFrame([], ", ".join(f"`{c.name}` {spark_type(c.type)}" for c in table.columns))
