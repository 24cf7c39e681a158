"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where the session names none, a temporary folder takes its place on a local master (tests on one machine) and is
    removed with the process; on any other master that is an error, since its executors would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("siltstone.shared.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that the executors of {master} share")
        found = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        found = "file://" + found
        spark.conf.set("siltstone.shared.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def staged(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet and read back: its lineage ends there, and the planner knows its size."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _held(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession):
    """Shuffle files of each action go as it ends, while this holds."""
    return _held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, size: int = 4 << 20):
    """Python gets rows in batches of about so many bytes, one row at least, while this holds; Spark and the worker each hold a batch or two."""
    return _held(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def cleaned(spark: SparkSession) -> int:
    """Remove all that this process wrote to the shared folder; call it when no result is read any more. Returns how many paths."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    gone = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone
