"""What a replica can be given from outside: commands, a key filter, a sink."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ebbflow.plans.store import Change, Manifest

COMMANDS = "instance string, topic string, key_json string, step decimal(20,0), tx_id decimal(20,0), action string, offset bigint"


class Commands(Protocol):
    """Operators' decisions about late changes."""

    def read(self, spark: SparkSession) -> DataFrame:
        """All commands so far, as COMMANDS rows."""


class KeyFilter(Protocol):
    """Keys that are not replicated."""

    def apply(self, changes: DataFrame) -> DataFrame:
        """The changes (with a column ``filter_key``) that pass."""


class Sink(Protocol):
    """Where tables, waiting changes and the checkpoint go in one step."""

    buckets: int

    def load(self) -> Manifest: ...

    def read(self, table: str, manifest: Manifest | None = None, buckets: list[int] | None = None) -> DataFrame | None: ...

    def pending(self, manifest: Manifest | None = None) -> DataFrame | None: ...

    def commit(self, old: Manifest, tables: dict[str, Change], pending: DataFrame | None = None, before_manifest: Callable[[], None] = lambda: None, **fields) -> Manifest: ...

    def fail(self, why: str) -> None: ...
