"""Partitioned tables of a measurement: append, read, import without duplicates, drop old dates."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import ConflictingTypes
from ..model import Measurement
from ..scratch import delete, file_system

DATE = "date"
#: Beside the dates: one small file for each schema that appends have had. Readers skip names that begin with _.
SCHEMAS = "_schemas"


def path_of(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/measurement={name}"


def append(df: DataFrame, m: Measurement, path: str, codec: str = "zstd", bloom: Sequence[str] = ()) -> None:
    """Append rows to their dates, sorted by series and time within files, so that Parquet
    statistics prune by tag and time. ``bloom``: columns that get Bloom filters.

    Dates are dealt by date and tags, so that a large date isn't one task.
    """
    rows = df.withColumn(DATE, F.to_date("time"))
    rows = rows.repartition(DATE, *m.tags).sortWithinPartitions(DATE, *m.tags, "time")
    writer = rows.write.mode("append").option("compression", codec).partitionBy(DATE)
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    _remember(df.sparkSession, path, rows.schema)
    writer.parquet(path)


def _remember(spark: SparkSession, path: str, schema: StructType) -> None:
    """Keep the schema beside the table; a type that contradicts what is there is an error before anything is written."""
    text = schema.json()
    at, fs = file_system(spark, f"{path}/{SCHEMAS}/{hashlib.md5(text.encode()).hexdigest()}.json")
    if not fs.exists(at):
        _merged([*_schemas(spark, path), schema])
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()


def _schemas(spark: SparkSession, path: str) -> list[StructType]:
    import json

    root, fs = file_system(spark, f"{path}/{SCHEMAS}")
    files = sorted(s.getPath().toString() for s in fs.listStatus(root)) if fs.exists(root) else []
    return [StructType.fromJson(json.loads(r["value"])) for r in spark.read.text(files, wholetext=True).collect()] if files else []


def _merged(schemas: Sequence[StructType]) -> StructType:
    fields = {}
    for schema in schemas:
        for f in schema.fields:
            if fields.setdefault(f.name, f).dataType != f.dataType:
                raise ConflictingTypes(f"column {f.name!r} is both {fields[f.name].dataType.simpleString()} and {f.dataType.simpleString()}")
    ordered = sorted(fields, key=lambda n: n == DATE)
    return StructType([fields[n] for n in ordered])


def schema_of(spark: SparkSession, path: str) -> StructType:
    """Of all appends, from the files beside the table; tables written by others have their footers read."""
    return _merged(known) if (known := _schemas(spark, path)) else spark.read.option("mergeSchema", "true").parquet(path).schema


def open_table(spark: SparkSession, m: Measurement, path: str) -> tuple[Measurement, DataFrame]:
    """The table and its measurement, with the date known as partition column. Schemas of all appends are merged."""
    df = spark.read.schema(schema_of(spark, path)).parquet(path)
    fields = tuple(c for c in df.columns if c not in {"time", DATE, *m.tags, *m.tiebreak})
    return replace(m, fields=fields, date=DATE), df


def without_existing(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't in ``existing``. Rows with a null in the key stay, and so do duplicates within ``new``."""
    return new.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def partitions(spark: SparkSession, path: str) -> list[str]:
    """Dates of the table, from its folders."""
    root, fs = file_system(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{DATE}="))


def drop_before(spark: SparkSession, path: str, cutoff: datetime) -> list[str]:
    """Delete the dates that end at or before ``cutoff``; returns them."""
    gone = [d for d in partitions(spark, path) if d < cutoff.date().isoformat()]
    for d in gone:
        delete(spark, f"{path}/{DATE}={d}")
    return gone


def changes(spark: SparkSession, m: Measurement, path: str, per_trigger: int | None = None) -> DataFrame:
    """The table as a stream of appends; a checkpointed reader resumes after the last file it has seen."""
    reader = spark.readStream.schema(schema_of(spark, path))
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)
