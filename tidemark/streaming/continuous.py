"""Continuous aggregates: rollups kept up to date, by stream or by increments.

A stream keeps the open buckets as state under a watermark. Emission is by ``update`` into an
upsert that replaces whole buckets, so that the last buckets appear too and late rows correct
them; ``append`` would hold the newest window back for ever. Exact percentiles keep all values
of an open bucket in state.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import InvalidQuery
from ..functions.durations import interval_text, micros
from ..model import Measurement, TimeRange
from .downsample import Rollup

_EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Continuous:
    """``processed``: buckets before it are final; ``retention``: microseconds to keep, or None."""

    name: str
    rollup: Rollup
    enabled: bool = True
    processed: datetime | None = None
    retention: int | None = None

    def pending(self, now: datetime) -> bool:
        """Whether a whole new bucket has ended since."""
        return self.enabled and (self.processed is None or self.processed < now - timedelta(microseconds=self.rollup.every))

    def due(self, now: datetime) -> TimeRange:
        """From where the last increment ended to the start of the current bucket."""
        end = _EPOCH + timedelta(microseconds=micros(now) // self.rollup.every * self.rollup.every)
        return TimeRange(self.processed, end)


class Registry:
    def __init__(self) -> None:
        self._known: dict[str, Continuous] = {}

    def register(self, c: Continuous) -> None:
        if c.name in self._known:
            raise InvalidQuery(f"continuous aggregate {c.name!r} exists")
        self._known[c.name] = c

    def unregister(self, name: str) -> None:
        del self._known[name]

    def get(self, name: str) -> Continuous:
        return self._known[name]

    def list(self) -> list[Continuous]:
        return [self._known[n] for n in sorted(self._known)]

    def enable(self, name: str, on: bool = True) -> None:
        self._known[name] = replace(self._known[name], enabled=on)

    def pending(self, now: datetime) -> list[Continuous]:
        return [c for c in self.list() if c.pending(now)]

    def increment(self, name: str, df: DataFrame, m: Measurement, now: datetime) -> DataFrame:
        """The buckets that have ended since the last call, and the mark moved past them."""
        c = self._known[name]
        times = c.due(now)
        self._known[name] = replace(c, processed=times.end)
        return c.rollup.apply(df, m, times)


def stream(rollup: Rollup, source: DataFrame, m: Measurement, late: str = "1 hour") -> DataFrame:
    """The rollup of a stream. Watermarks need a timestamp with zone, which is UTC here."""
    timed = source.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late)
    return rollup.apply(timed, m)


def start(
    rollup: Rollup, source: DataFrame, m: Measurement, sink: str, checkpoint: str, late: str = "1 hour", once: bool = True, trigger: str = "1 minute"
) -> StreamingQuery:
    """Run the stream into a Parquet table of bucket revisions; ``latest`` reads the current ones.

    Each batch is written to a folder of its own number, so that a batch that is repeated after
    a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("revision", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = stream(rollup, source, m, late).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)).start()


def latest(spark: SparkSession, rollup: Rollup, sink: str) -> DataFrame:
    """The newest revision of every bucket."""
    rows = spark.read.parquet(sink)
    names = [o.name for o in rollup.outputs]
    newest = rows.groupBy("time", *rollup.group_by).agg(F.max_by(F.struct(*names), "revision").alias("v"))
    return newest.select(F.col("time").cast("timestamp_ntz").alias("time"), *rollup.group_by, "v.*")


def sessions(df: DataFrame, m: Measurement, gap: str, value: str) -> DataFrame:
    """Per series, bursts of rows with less than ``gap`` between them."""
    from ..functions.durations import duration_micros

    window = F.session_window("time", interval_text(duration_micros(gap)))
    out = df.groupBy(window.alias("w"), *m.tags).agg(F.count("*").alias("points"), F.sum(F.col(value).cast("double")).alias("total"))
    return out.select(F.col("w.start").alias("time"), F.col("w.end").alias("end"), *m.tags, "points", "total")
