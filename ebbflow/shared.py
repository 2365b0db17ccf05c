"""The folder that the driver and all executors share, and tables that cut lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only where neither that setting nor a checkpoint folder is set and Spark runs on one machine, as in tests, a temporary one is made.
    """
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="ebbflow-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
