"""Series and tag metadata, as distributed queries over a measurement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import And, Measurement, Or, Tag
from .filters import to_column


def series_id(m: Measurement) -> Column:
    """A stable id from the measurement's name and its tags in order of name. For display; group by the tags."""
    parts = [F.lit(m.name)]
    for tag in sorted(m.tags):
        parts += [F.lit(tag), F.col(tag)]
    return F.xxhash64(*parts)


def series(df: DataFrame, m: Measurement) -> DataFrame:
    """One row per series with its first and last time and its number of points."""
    found = df.groupBy(*m.tags).agg(F.min("time").alias("first_seen"), F.max("time").alias("last_seen"), F.count("*").alias("points"))
    return found.select(series_id(m).alias("series_id"), *m.tags, "first_seen", "last_seen", "points")


def series_cardinality(df: DataFrame, m: Measurement) -> DataFrame:
    return df.select(*m.tags).distinct().agg(F.count("*").alias("series_count"))


def tag_keys(df: DataFrame, m: Measurement) -> DataFrame:
    """Tags with a value somewhere, and in how many rows. One pass."""
    counts = df.agg(*[F.count(t).alias(t) for t in m.tags])
    pairs = F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).alias("rows")) for t in m.tags])
    return counts.select(F.explode(pairs).alias("x")).select("x.tag", "x.rows").filter("rows > 0")


def tag_values(df: DataFrame, tag: str) -> DataFrame:
    return df.filter(F.col(tag).isNotNull()).groupBy(F.col(tag).alias("value")).agg(F.count("*").alias("rows"))


def find_series(df: DataFrame, m: Measurement, tags: Sequence[tuple[str, str]], how: str = "all") -> DataFrame:
    """Series with all, any or none of the tag values."""
    leaves = tuple(Tag(k, "eq", v) for k, v in tags)
    condition = to_column({"all": And, "any": Or, "none": Or}[how](leaves))
    found = df.select(*m.tags).distinct()
    if condition is None:
        return found if how != "any" else found.limit(0)
    return found.filter(~condition if how == "none" else condition)
