"""Tables written to the folder that the driver and all executors share.

Lineage is cut by writing Parquet there and reading it back, so a lost executor
costs the tasks it was running and nothing that was finished before.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder of its own and a
    cluster gets a folder in the warehouse, which is shared there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        key = spark.sparkContext.applicationId
        if key not in _LOCAL:
            _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="linkforge-")
        return _LOCAL[key]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_linkforge"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Python workers get at most so many rows at once; None: as many as the session says.

    A batch of whole texts is held by the JVM outside its heap and again by the worker.
    """
    before = spark.conf.get(_BATCH)
    if rows:
        spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def materialise(df: DataFrame, label: str, batch_rows: int | None = None) -> tuple[DataFrame, str]:
    """Write df to the shared folder; return the table read back and its path.

    The shuffle files that the write made are dropped when it ends: nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        with batches_of(spark, batch_rows):
            df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of materialise() that nothing will read again."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def on_workers(spark: SparkSession) -> None:
    """Let Python workers that share this machine's files import the package from where it is now."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
