"""The data model: positions, log rows, tables, replicas."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Positions are unsigned 64-bit pairs, which a bigint can't hold.
UINT64 = "decimal(20,0)"
UINT64_MAX = 18446744073709551615

#: A raw message, named as Spark's topic sources name it; ``batch`` is the micro-batch that delivered it.
MESSAGE = "topic string, partition bigint, offset bigint, batch bigint, value string"


class Strategy(Enum):
    """What to do with a change that arrives too late."""

    STOP = "STOP"
    CONTINUE = "CONTINUE"

    @classmethod
    def named(cls, text: str | None) -> Strategy:
        """Letter case doesn't matter; no text means STOP."""
        found = (text or "STOP").strip().upper() or "STOP"
        try:
            return cls(found)
        except ValueError:
            raise ValueError(f"unknown problem strategy {text!r}; STOP and CONTINUE are known") from None


class Stage(Enum):
    INITIAL_SCAN = "INITIAL_SCAN"
    RUN = "RUN"


class ReplicationHalted(RuntimeError):
    """Raised after the fatal state was stored; the replica must not go on by itself."""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    nullable: bool = True


@dataclass(frozen=True)
class TableSpec:
    """A destination table: its primary key in order, and all columns with their types."""

    name: str
    key: tuple[str, ...]
    columns: tuple[ColumnSpec, ...]

    def __post_init__(self):
        known = [c.name for c in self.columns]
        if len(set(known)) != len(known) or not self.key or not set(self.key) <= set(known):
            raise ValueError(f"table {self.name}: columns must differ, and the key must be some of them")

    def column(self, name: str) -> ColumnSpec:
        return next(c for c in self.columns if c.name == name)

    @property
    def values(self) -> tuple[ColumnSpec, ...]:
        return tuple(c for c in self.columns if c.name not in self.key)


@dataclass(frozen=True)
class StreamSpec:
    """One changefeed: its topic, its number in the replica, its partitions and the table that it feeds."""

    topic: str
    stream_id: int
    partitions: int
    table: TableSpec
    strategy: Strategy = Strategy.STOP
    mon_tag: str = ""

    @property
    def tag(self) -> str:
        return self.mon_tag or self.topic


@dataclass(frozen=True)
class ReplicaSpec:
    """All feeds that are applied together."""

    instance: str
    streams: tuple[StreamSpec, ...]
    #: Changes applied at once while the initial scan lasts.
    chunk: int = 1000
    #: Longest expected time between heartbeats, in seconds.
    heartbeat_interval: float = 10.0
    single: bool = field(default=False)

    def __post_init__(self):
        if self.heartbeat_interval <= 0:
            raise ValueError("heartbeat_interval must be positive; the lease's time to live is twice that")
        if len({s.topic for s in self.streams}) != len(self.streams) or len({s.stream_id for s in self.streams}) != len(self.streams):
            raise ValueError("topics and stream numbers must differ")

    @property
    def partitions(self) -> int:
        return sum(s.partitions for s in self.streams)

    def stream(self, topic: str) -> StreamSpec:
        return next(s for s in self.streams if s.topic == topic)


def position(step: str | Column = "step", tx: str | Column = "tx_id") -> Column:
    """A position as one value; such values compare by step, then by tx_id."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(col(step).cast(UINT64).alias("step"), col(tx).cast(UINT64).alias("tx_id"))



def zero() -> Column:
    """The position before all others."""
    return position(F.lit(0), F.lit(0))
