"""Retention policies and storage tiers over date partitions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..functions.durations import duration_micros
from ..scratch import file_system
from ..sources.tables import DATE, drop_before, partitions, path_of

_MOVING = "_moving."


@dataclass(frozen=True)
class Policy:
    """``pattern``: a name, or with ``*`` and ``?``; the longest pattern that matches wins."""

    name: str
    pattern: str
    keep: int  # microseconds
    default: bool = False

    @classmethod
    def of(cls, name: str, pattern: str, keep: str, default: bool = False) -> Policy:
        return cls(name, pattern, duration_micros(keep), default)

    def matches(self, measurement: str) -> bool:
        return fnmatchcase(measurement, self.pattern.replace("[", "[[]"))

    def cutoff(self, now: datetime) -> datetime:
        return now - timedelta(microseconds=self.keep)


def policy_for(policies: Sequence[Policy], measurement: str) -> Policy | None:
    found = [p for p in policies if p.matches(measurement)]
    if found:
        return max(found, key=lambda p: (len(p.pattern), p.name))
    return next((p for p in policies if p.default), None)


def retained(df: DataFrame, policy: Policy | None, now: datetime) -> DataFrame:
    """Rows the policy keeps."""
    return df if policy is None else df.filter(F.col("time") >= F.lit(policy.cutoff(now)).cast("timestamp_ntz"))


def enforce(spark: SparkSession, root: str, measurements: Sequence[str], policies: Sequence[Policy], now: datetime) -> dict[str, list[str]]:
    """Drop whole dates past each measurement's own policy."""
    out = {}
    for name in measurements:
        if policy := policy_for(policies, name):
            out[name] = drop_before(spark, path_of(root, name), policy.cutoff(now))
    return out


@dataclass(frozen=True)
class Tiers:
    """Ages from which data is warm and cold, and each tier's codec."""

    warm: int = duration_micros("7d")
    cold: int = duration_micros("30d")
    codecs: tuple[tuple[str, str], ...] = (("hot", "lz4"), ("warm", "zstd"), ("cold", "zstd"))

    def __post_init__(self) -> None:
        if not 0 < self.warm < self.cold:
            raise InvalidQuery("tiers need 0 < warm < cold")

    def of(self, age: timedelta) -> str:
        age_us = age // timedelta(microseconds=1)
        return "cold" if age_us >= self.cold else "warm" if age_us >= self.warm else "hot"

    def column(self, time: Column, now: datetime) -> Column:
        at = lambda age: F.lit(now - timedelta(microseconds=age)).cast("timestamp_ntz")
        return F.when(time <= at(self.cold), "cold").when(time <= at(self.warm), "warm").otherwise("hot")


def _names(fs, folder) -> list[str]:
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def _rewrite(spark: SparkSession, source: str, target: str, codec: str) -> None:
    # A folder whose name begins with _ has to be read file by file.
    at, fs = file_system(spark, source)
    files = [f"{source}/{n}" for n in _names(fs, at) if not n.startswith(("_", "."))]
    spark.read.option("mergeSchema", "true").parquet(*files).write.mode("overwrite").option("compression", codec).parquet(target)


def move(spark: SparkSession, source: str, targets: dict[str, str], tiers: Tiers, now: datetime) -> dict[str, str]:
    """Rewrite dates that have left the hot tier to their tier's folder and codec; returns date to tier.

    What a tier holds already stays: each move of a date is a folder of its own in it,
    ``date=D/move=M``. Steps, each of which a later call completes after a stop:
    the rows are written beside the tier under a hidden name; the source's folder is hidden by
    a rename, and written again if rows came in meanwhile; the new folder is made visible by a
    rename; the hidden source goes. Between the two renames the date is in neither place, and
    rows are never in both. Renames have to be atomic, as in HDFS.
    """
    codecs, moved = dict(tiers.codecs), {}
    root, fs = file_system(spark, source)
    for name in _names(fs, root):  # stopped half-way
        if name.startswith(_MOVING):
            tier, date, number = name.removeprefix(_MOVING).split(".")
            if tier in targets:
                _finish(spark, source, targets[tier], tier, date, number, codecs[tier], None)
                moved[date] = tier
    for date in partitions(spark, source):
        tier = tiers.of(now - datetime.fromisoformat(date) - timedelta(days=1))
        if tier != "hot" and tier in targets:
            number = "m" + uuid.uuid4().hex
            folder = file_system(spark, f"{source}/{DATE}={date}")[0]
            seen = _names(fs, folder)
            _rewrite(spark, f"{source}/{DATE}={date}", f"{targets[tier]}/_{number}", codecs[tier])
            hidden = file_system(spark, f"{source}/{_MOVING}{tier}.{date}.{number}")[0]
            if not fs.rename(folder, hidden):
                raise OSError(f"can't rename {folder.toString()}")
            _finish(spark, source, targets[tier], tier, date, number, codecs[tier], seen)
            moved[date] = tier
    return moved


def _finish(spark: SparkSession, source: str, target: str, tier: str, date: str, number: str, codec: str, seen: list[str] | None) -> None:
    """Complete a move whose source is hidden; ``seen``: the files that were written, if that is known."""
    hidden, fs = file_system(spark, f"{source}/{_MOVING}{tier}.{date}.{number}")
    done, target_fs = file_system(spark, f"{target}/{DATE}={date}/move={number}")
    if not target_fs.exists(done):
        ready = file_system(spark, f"{target}/_{number}")[0]
        if _names(fs, hidden) != seen:
            _rewrite(spark, hidden.toString(), ready.toString(), codec)
        target_fs.mkdirs(done.getParent())
        if not target_fs.rename(ready, done):
            raise OSError(f"can't rename {ready.toString()}")
    fs.delete(hidden, True)
