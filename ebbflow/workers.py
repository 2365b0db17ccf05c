"""Lets Python workers import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

HOME = str(Path(__file__).resolve().parent.parent)


def reach(spark: SparkSession) -> None:
    """Puts the package's folder on the Python path of workers that start from now on.

    It serves sessions on one machine and clusters that hold the package at the same place; others ship it with
    ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, HOME])
