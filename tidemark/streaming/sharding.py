"""Shard columns: deterministic placements for writing and for co-located reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..functions.durations import duration_micros
from ..model import Measurement


def _hashed(text: Column) -> Column:
    """A number of 52 bits that any engine with MD5 can compute, so that other readers find a shard too."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def shard_column(m: Measurement, how: str, shards: int, every: str = "1d") -> Column:
    """``measurement``, ``series``, ``time`` or ``composite`` (series and time) to 0 .. shards - 1."""
    if shards < 1:
        raise InvalidQuery("at least one shard")
    n = F.lit(shards).cast("bigint")
    series = F.concat_ws(",", F.lit(m.name), *[F.concat(F.lit(f"{t}="), F.col(t)) for t in sorted(m.tags)])
    slot = F.floor(F.unix_micros(F.col("time").cast("timestamp")) / F.lit(duration_micros(every)).cast("decimal(20,0)")).cast("bigint")
    match how:
        case "measurement":
            return _hashed(F.lit(m.name)) % n
        case "series":
            return _hashed(series) % n
        case "time":
            return F.pmod(slot, n)
        case "composite":
            return _hashed(F.concat_ws("@", series, slot.cast("string"))) % n
    raise InvalidQuery(f"unknown sharding: {how!r}")


def repartition_by_shard(df: DataFrame, m: Measurement, how: str, shards: int, every: str = "1d") -> DataFrame:
    return df.withColumn("shard", shard_column(m, how, shards, every)).repartition(shards, "shard")


def acknowledgements(mode: str, replicas: int) -> int:
    """How many replicas a write waits for: all, a majority, or none."""
    return {"sync": replicas, "quorum": replicas // 2 + 1, "async": 0}[mode]
