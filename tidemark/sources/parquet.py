"""Parquet files of others to measurements."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..model import Measurement

_NUMBERS = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint", "float": "double", "double": "double", "boolean": "boolean", "string": "string"}
_PER_SECOND = {"s": 1, "ms": 10**3, "us": 10**6, "ns": 10**9}


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """``column, type`` of the files, from their footers."""
    return spark.createDataFrame(spark.read.parquet(path).dtypes, "column string, type string")


def as_time(column: Column, dtype: str, unit: str = "ns") -> Column:
    """Timestamps as they are; integers by unit; dates at midnight; strings parsed. In UTC, without zone."""
    if dtype == "timestamp_ntz":
        return column
    if dtype in ("timestamp", "date", "string"):
        return column.cast("timestamp_ntz")
    if dtype in ("bigint", "int"):
        n = _PER_SECOND[unit]
        value = column.cast("bigint")
        micros = F.floor(value / F.lit(n // 10**6).cast("decimal(20,0)")).cast("bigint") if n > 10**6 else value * (10**6 // n)
        return F.timestamp_micros(micros).cast("timestamp_ntz")
    raise InvalidQuery(f"no time column: type {dtype}")


def import_parquet(
    spark: SparkSession, path: str, name: str, tags: Sequence[str] = (), time: str | None = None, unit: str = "ns"
) -> tuple[Measurement, DataFrame]:
    """Columns with roles and supported types; others are dropped, and rows without any field.

    The time column is the given one, else ``time`` or ``ts``. Unsigned 64-bit integers keep
    their value as decimal(20,0).
    """
    df = spark.read.parquet(path)
    types = dict(df.dtypes)
    time = next((c for c in (time, "time", "ts") if c in types), None)
    if time is None:
        raise InvalidQuery(f"no time column in {path}")
    kept = {c: F.col(c).cast(_NUMBERS[t]) if t in _NUMBERS else F.col(c) for c, t in types.items() if c != time and c not in tags and (t in _NUMBERS or t == "decimal(20,0)")}
    m = Measurement(name, "time", tuple(t for t in tags if t in types), tuple(kept))
    rows = df.select(as_time(F.col(time), types[time], unit).alias("time"), *[F.col(t).cast("string").alias(t) for t in m.tags], *[c.alias(n) for n, c in kept.items()])
    return m, rows.filter(reduce(or_, [F.col(f).isNotNull() for f in m.fields])) if m.fields else rows.limit(0)
