"""A replica's configuration file (YAML or JSON) and its verification."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from ebbflow.functions.convert import table_spec
from ebbflow.functions.model import ReplicaSpec, StreamSpec, Strategy, TableSpec


class ConfigError(ValueError):
    """What is wrong with a configuration."""


@dataclass(frozen=True)
class Credentials:
    """One side's access: a key file or a static token."""

    key_file: str = ""
    token: str = ""

    def __post_init__(self):
        if bool(self.key_file) == bool(self.token):
            raise ConfigError("exactly one of a key file and a static token must be given")


@dataclass(frozen=True)
class Config:
    replica: ReplicaSpec
    root: str
    source: Credentials | None = None
    destination: Credentials | None = None
    dead_letters: str | None = None
    commands: str | None = None
    blocked_keys: str | None = None
    metrics_port: int | None = None
    log_level: str = "info"


def _text(spark: SparkSession, path: str) -> str:
    if not path:
        raise ConfigError("the path of the configuration is empty")
    found = spark.read.option("wholetext", True).text(path).first()
    if found is None:
        raise ConfigError(f"{path} is empty")
    return found[0]


def _parsed(text: str) -> dict:
    try:
        import yaml
    except ImportError:
        try:
            got = json.loads(text)
        except json.JSONDecodeError as why:
            raise ConfigError(f"not JSON, and no YAML reader is installed: {why}") from None
    else:
        try:
            got = yaml.safe_load(text)
        except yaml.YAMLError as why:
            raise ConfigError(f"not YAML: {why}") from None
    if not isinstance(got, dict):
        raise ConfigError("a configuration is a mapping")
    return got


def _credentials(given: dict, side: str) -> Credentials | None:
    own = {k: given.get(f"{side}_{k}", "") for k in ("key_file", "token")}
    return Credentials(**own) if any(f"{side}_{k}" in given for k in own) else None


def verify(given: dict, tables: dict[str, TableSpec | StructType]) -> Config:
    """The configuration of a mapping. ``tables`` describes the destination tables that streams name."""
    for name in ("instance", "root", "streams"):
        if given.get(name) in (None, "", []):
            raise ConfigError(f"{name} is missing")
    streams = []
    for k, s in enumerate(given["streams"]):
        for name in ("topic", "table", "partitions"):
            if not s.get(name):
                raise ConfigError(f"stream {k}: {name} is missing")
        spec = tables.get(s["table"])
        if isinstance(spec, StructType):
            spec = table_spec(s["table"], spec, tuple(s.get("key", ())))
        if spec is None:
            raise ConfigError(f"stream {k}: table {s['table']} is not described")
        try:
            strategy = Strategy.named(s.get("problem_strategy"))
        except ValueError as why:
            raise ConfigError(f"stream {k}: {why}") from None
        streams.append(StreamSpec(s["topic"], k, int(s["partitions"]), spec, strategy, s.get("mon_tag", "")))
    level = str(given.get("log_level", "info")).lower()
    if level not in ("debug", "info", "warn", "error"):
        raise ConfigError(f"unknown log level {level!r}")
    try:
        replica = ReplicaSpec(str(given["instance"]), tuple(streams), int(given.get("chunk", 1000)), float(given.get("max_expected_heartbeat_interval", 10)), not given.get("multiple_instances_mode", False))
    except ValueError as why:
        raise ConfigError(str(why)) from None
    port = given.get("metrics_port")
    return Config(replica, given["root"], _credentials(given, "source"), _credentials(given, "destination"), given.get("dead_letters"), given.get("commands"), given.get("blocked_keys"), None if port is None else int(port), level)


def load(spark: SparkSession, path: str, tables: dict[str, TableSpec | StructType]) -> Config:
    """Reads and verifies a file in any store that Spark reads."""
    return verify(_parsed(_text(spark, path)), tables)
