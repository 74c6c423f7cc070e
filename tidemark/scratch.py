"""Working tables in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
#: Used only where the session names no folder and all of Spark is in this process, as in local tests.
LOCAL_DEFAULT = "/tmp/checkpoints"


def work_root(spark: SparkSession) -> str:
    """The shared folder. Without one a cluster's executors would each write to a disk of their own, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_DEFAULT).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system for ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    at, fs = file_system(spark, path)
    fs.delete(at, True)


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` and read it back; also its path, for ``delete``."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies, if it isn't installed."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
