"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ebbflow import workers

#: Words of the digest contracts: runs of characters other than space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of input rows that a worker turns into Python objects at once.
SLICE = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table; only Spark opens the path, so it may lie in any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's ``spark.checkpoint.dir``.

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


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; what reads it takes only the columns that it needs."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[id(found)] = (weakref.ref(found, lambda _, key=id(found): _WRITTEN.pop(key, None)), path)
    return found


_WRITTEN: dict[int, tuple] = {}


def drop(table: DataFrame) -> None:
    """Deletes what ``written`` wrote; nothing that is still to be computed may read it."""
    held = _WRITTEN.pop(id(table), None)
    if held is not None:
        delete(table.sparkSession, held[1])


def release(spark: SparkSession) -> None:
    """Lets go of memory, and lets Spark delete the shuffle files of steps whose results were written and that nothing refers to any more.

    Spark does so when the driver's JVM collects the references, which a large heap may put off for half an hour.
    """
    gc.collect()
    ease()
    spark._jvm.java.lang.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Gives what the driver's JVM has freed outside its heap (threads, compilers, codecs) back to the machine; false where it has no such command."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    of = jvm.java.lang.Class.forName
    kinds, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = of(kind)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        # By the interface: the server's own class is not open to callers.
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return False
    return True


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def power_of_two(x: float) -> int:
    """The least power of two that is at least ``x`` (and at least 1)."""
    return 1 << max(0, math.ceil(math.log2(max(1.0, x))))


def unsigned_crc32(column) -> F.Column:
    """CRC-32 of a column's text as an unsigned number."""
    return F.crc32(column.cast("string").cast("binary"))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, whatever the letter case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def enter(step: str) -> None:
    """Lets go of what a worker remembered in an earlier step."""
    if _KEPT.get("step") != step:
        _KEPT.clear()
        _KEPT["step"] = step


def ease() -> None:
    """Gives the memory that a finished partition has left free back to the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def eased(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as a step of its own, and then ``ease``."""
    step = fresh()

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(step)
        yield from run(batches)
        ease()

    return wrapped


def map_arrow(df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Applies ``work`` to batches of columns given as Python lists; Arrow carries the batches.

    ``work`` gets rows of about ``SLICE`` bytes at once, or one longer row, so memory doesn't grow with a partition.
    """
    workers.reach(df.sparkSession)
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)
    step = fresh()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(step)
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = work({n: part.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)
        ease()

    return df.mapInArrow(run, out)


_KEPT: dict[str, object] = {}


def fresh() -> str:
    """A name for something that workers build once."""
    return uuid.uuid4().hex


def once(name: str, build: Callable[[], object]):
    """What ``build`` made the first time that this worker asked for ``name``.

    Only the latest is kept: a worker that goes on to another operator lets go of what the one before remembered.
    """
    if name not in _KEPT:
        step = _KEPT.get("step")
        _KEPT.clear()
        _KEPT["step"] = step
        _KEPT[name] = build()
    return _KEPT[name]
