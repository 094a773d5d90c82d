"""Staging tables: a load's derived rows written once as Parquet and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def staging_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; where unset, a local master's own temporary folder, or the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="linkforge-staging-"))
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"


def staged(df: DataFrame, name: str) -> DataFrame:
    path = f"{staging_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
