"""Shared working storage for multi-stage operators.

Intermediate tables are Parquet in the folder named by ``spark.checkpoint.dir``,
which every executor sees, so a lost executor costs a re-read and never a
re-computation of the stages before.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import delete, new_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffle_cleanup(spark: SparkSession):
    """Shuffle files of a write go when it ends; its rows are in the table then."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffle_cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no live plan reads any more."""
    for table in tables:
        path = getattr(table, "_tidemark_path", None)
        if path:
            delete(table.sparkSession, path)


def within(df: DataFrame, limit: int) -> bool:
    """Whether a materialised table has at most ``limit`` rows, so that it may be broadcast."""
    return df.count() <= limit


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, whatever else the table carries."""
    return docs.select(F.col(id_col).cast(T.LongType()).alias("doc_id"), F.col(text_col).alias("text"))
