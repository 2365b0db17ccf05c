"""JSON texts to the destination's types, and what violates a table's schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from ebbflow.functions.model import UINT64, UINT64_MAX, ColumnSpec, TableSpec

INTEGER = r"^-?[0-9]+$"
NUMBER = r"^-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$"
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
MICROS = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}[.][0-9]{6}Z$"


def _integer(kind: str, low: int | None = None, high: int | None = None) -> Callable[[Column], Column]:
    def convert(v: Column) -> Column:
        found = F.when(v.rlike(INTEGER), v.try_cast(kind))
        return found if low is None else F.when(found.between(F.lit(low), F.lit(str(high)).cast(kind)), found)

    return convert


def _number(kind: str) -> Callable[[Column], Column]:
    return lambda v: F.when(v.rlike(NUMBER), v.try_cast(kind))


def _same(v: Column) -> Column:
    return v


#: Type name to (Spark type, conversion); a conversion gives null for what it rejects.
TYPES: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "Bool": ("boolean", lambda v: F.when(v.isin("true", "false"), v == "true")),
    "Int8": ("tinyint", _integer("tinyint")),
    "Int16": ("smallint", _integer("smallint")),
    "Int32": ("int", _integer("int")),
    "Int64": ("bigint", _integer("bigint")),
    "Uint8": ("smallint", _integer("smallint", 0, 255)),
    "Uint16": ("int", _integer("int", 0, 65535)),
    "Uint32": ("bigint", _integer("bigint", 0, 4294967295)),
    "Uint64": (UINT64, _integer(UINT64, 0, UINT64_MAX)),
    "Float": ("float", _number("float")),
    "Double": ("double", _number("double")),
    "Date": ("date", lambda v: F.date_from_unix_date(_integer("int", 0, 2**31 - 1)(v))),
    "Timestamp": ("timestamp", lambda v: F.when(v.rlike(MICROS), F.try_to_timestamp(v, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")))),
    "Interval": ("bigint", _integer("bigint")),
    "TzDate": ("string", _same),
    "TzDatetime": ("string", _same),
    "TzTimestamp": ("string", _same),
    "String": ("binary", lambda v: F.try_to_binary(v, F.lit("base64"))),
    "Utf8": ("string", _same),
    "Yson": ("string", _same),
    "Json": ("string", _same),
    "Uuid": ("string", lambda v: F.when(v.rlike(UUID), F.lower(v))),
}


def spark_type(name: str) -> str:
    try:
        return TYPES[name][0]
    except KeyError:
        raise ValueError(f"unsupported type {name}") from None


def convert(text: Column, name: str) -> Column:
    """The value of a JSON text (null if the text is null or rejected)."""
    kind = spark_type(name)
    return TYPES[name][1](text).cast(kind)


#: Destination types by Spark type, where a schema is all that is known of a table.
OF_SPARK = {
    "boolean": "Bool", "tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", UINT64: "Uint64", "float": "Float",
    "double": "Double", "date": "Date", "timestamp": "Timestamp", "string": "Utf8", "binary": "String",
}


def table_spec(name: str, schema: StructType, key: tuple[str, ...]) -> TableSpec:
    """A table's description from the schema of its stored rows; key columns are never null."""
    unknown = [f.name for f in schema if f.dataType.simpleString() not in OF_SPARK]
    if unknown:
        raise ValueError(f"table {name}: no type fits columns {unknown}")
    return TableSpec(name, key, tuple(ColumnSpec(f.name, OF_SPARK[f.dataType.simpleString()], f.nullable and f.name not in key) for f in schema))


def interval(micros: Column) -> Column:
    """An Interval's microseconds as a day-time interval."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micros / F.lit(1000000).cast("decimal(20,6)"))


def row(table: TableSpec, keep: tuple[str, ...] = ()) -> list[Column]:
    """Select list: the typed key by position, the typed columns by name, and ``keep``."""
    keys = [convert(F.get(F.col("key"), F.lit(i)), table.column(n).type).alias(n) for i, n in enumerate(table.key)]
    return [F.col(k) for k in keep] + keys + [convert(F.col("cols")[c.name], c.type).alias(c.name) for c in table.values]


def violation(table: TableSpec) -> Column:
    """Why a change doesn't fit the table, or null."""
    names = [c.name for c in table.values]
    cols = F.col("cols")
    keys = F.col("key")
    unknown = F.array_sort(F.array_except(F.map_keys(cols), F.array(*map(F.lit, names)).cast("array<string>")))
    why = F.when(F.size(keys) != len(table.key), F.format_string("key has %d values, the table needs %d", F.size(keys), F.lit(len(table.key))))
    for i, n in enumerate(table.key):
        value = F.get(keys, F.lit(i))
        why = why.when(value.isNull() | convert(value, table.column(n).type).isNull(), f"bad value for key column {n}")
    why = why.when(F.size(unknown) > 0, F.concat(F.lit("unknown column "), F.get(unknown, F.lit(0))))
    for c in sorted(table.values, key=lambda c: c.name):
        there = F.coalesce(F.map_contains_key(cols, F.lit(c.name)), F.lit(False))
        if not c.nullable:
            why = why.when(there & cols[c.name].isNull(), f"null in column {c.name}")
        why = why.when(there & cols[c.name].isNotNull() & convert(cols[c.name], c.type).isNull(), f"bad value for column {c.name}")
    return why


def violations(changes: DataFrame, table: TableSpec) -> DataFrame:
    """The changes that don't fit the table, with the reason."""
    return changes.withColumn("violation", violation(table)).filter("violation is not null")


def fitting(changes: DataFrame, table: TableSpec) -> DataFrame:
    return changes.filter(violation(table).isNull())
