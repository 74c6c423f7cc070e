"""Tumbling time buckets and gap filling."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from .durations import duration_micros, interval_text, micros

#: Buckets that one row may bring; longer gaps are cut.
PIECE = 4096


def time_bucket(time: Column | str, width: str | int, origin: datetime | None = None) -> Column:
    """Start of the bucket of ``time``. Buckets are anchored at the epoch, or at ``origin``.

    This is Spark's own tumbling window, so the optimizer and streaming know it.
    """
    size = duration_micros(width) if isinstance(width, str) else width
    offset = micros(origin) % size if origin else 0
    window = F.window(time, interval_text(size), startTime=interval_text(offset)) if offset else F.window(time, interval_text(size))
    return window["start"]


def _points(first: Column, last: Column, size: int) -> Column:
    """first, first + size, .. last; empty where last < first."""
    return F.when(last >= first, F.sequence(first, last, F.lit(size))).otherwise(F.array().cast("array<bigint>"))


def gap_fill(
    rows: DataFrame, bucket: str, width: str | int, start: datetime, end: datetime, keys: Sequence[str] = (), zero: Sequence[str] = (), origin: datetime | None = None
) -> DataFrame:
    """``rows`` with a row for every bucket that [start, end) touches, for every combination of keys present.

    Columns in ``zero`` become 0 in added rows, the others null. Rows have one row for each bucket
    and combination. Nothing is joined and ``rows`` is computed once: each row brings the empty buckets up to the
    next one of its keys, and the first also those before it. Long gaps are cut in pieces of
    ``PIECE`` buckets, which are dealt anew. Without keys the pieces of the whole grid stand in
    for a first row, so that it is filled even where there are no rows.
    """
    if end <= start:
        raise InvalidQuery("a gap fill needs start < end")
    size = duration_micros(width) if isinstance(width, str) else width
    anchor = micros(origin) if origin else 0
    first = anchor + (micros(start) - anchor) // size * size
    last = anchor + (micros(end) - 1 - anchor) // size * size
    kind = rows.schema[bucket].dataType.simpleString()
    at = F.unix_micros(F.col(bucket).cast("timestamp"))
    known = rows.select(F.struct(*rows.columns).alias("row"), at.alias("at"), *[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)])
    over = [f"key{i}" for i in range(len(keys))]
    if not keys:
        # Each piece of the grid takes the rows in it, so no window runs over all of them.
        known = known.withColumn("piece", F.floor((F.col("at") - first) / F.lit(size * PIECE).cast("decimal(20,0)")).cast("bigint"))
        lead = rows.sparkSession.range((last - first) // size // PIECE + 1).select(F.lit(None).cast(known.schema["row"].dataType).alias("row"), (F.col("id") * (size * PIECE) + (first - size)).alias("at"), F.col("id").alias("piece"))
        known, over = known.unionByName(lead), ["piece"]
    window = Window.partitionBy(*over).orderBy("at")
    # The empty buckets after a row end before the next row of its window, or with the piece or the grid.
    stop = F.least(F.lit(last), (F.col("piece") + 1) * (size * PIECE) + (first - size)) if not keys else F.lit(last)
    upto = F.coalesce(F.lead("at").over(window) - size, stop)
    since = F.when(F.lag("at").over(window).isNull(), F.lit(first)) if keys else F.lit(None).cast("bigint")
    spans = known.select("row", "at", *over, upto.alias("upto"), since.alias("since"))
    spans = spans.withColumn("begin", F.col("at") + size)
    before = _points(F.col("since"), F.col("at") - size, size * PIECE) if keys else F.array().cast("array<bigint>")
    after = _points(F.col("begin"), F.col("upto"), size * PIECE)
    piece = lambda stop: lambda x: F.struct(x.alias("lo"), F.least(x + size * (PIECE - 1), stop).alias("hi"))
    own = F.when(F.col("row").isNotNull(), F.array(F.struct(F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi")))).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint>>"))
    pieces = spans.select("row", F.explode(F.concat(own, F.transform(before, piece(F.col("at") - size)), F.transform(after, piece(F.col("upto"))))).alias("p"))
    if keys and (last - first) // size >= PIECE:
        pieces = pieces.repartition(F.xxhash64(*[F.col(f"row.{k}") for k in keys], "p"))
    times = F.when(F.col("p.lo").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.sequence(F.col("p.lo"), F.col("p.hi"), F.lit(size)))
    filled = pieces.select("row", F.explode(times).alias("added"))
    out = []
    for c in rows.columns:
        value, dtype = F.col(f"row.`{c}`"), rows.schema[c].dataType
        if c == bucket:
            added = F.timestamp_micros("added").cast(kind)
        elif c in keys:
            added = value
        else:
            added = (F.lit(0) if c in zero else F.lit(None)).cast(dtype)
        out.append(F.when(F.col("added").isNull(), value).otherwise(added).alias(c))
    return filled.select(*out)
