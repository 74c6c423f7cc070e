"""Downsampling rules and their batch execution."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..errors import InvalidQuery
from ..functions.aggregates import Function, aggregate
from ..functions.buckets import time_bucket
from ..functions.durations import duration_micros
from ..model import Measurement, TimeRange
from ..operators.filters import in_range


@dataclass(frozen=True)
class Output:
    field: str
    function: Function
    name: str


@dataclass(frozen=True)
class Rollup:
    """Source measurement to target: aggregates of fields by time bucket and tags."""

    source: str
    target: str
    every: int
    outputs: tuple[Output, ...] = ()
    group_by: tuple[str, ...] = ()

    @classmethod
    def of(cls, source: str, target: str, every: str, group_by: tuple[str, ...] = ()) -> Rollup:
        return cls(source, target, duration_micros(every), (), tuple(group_by))

    def add(self, field: str, function: str, name: str | None = None) -> Rollup:
        """One more output. A mean keeps its field's name, others get the function as suffix."""
        f = Function.parse(function)
        label = f"p{f.percent}" if f.percent is not None else f.name
        name = name or (field if f.name == "mean" else f"{field}_{label}")
        if any(o.name == name for o in self.outputs):
            raise InvalidQuery(f"two outputs named {name!r}")
        return replace(self, outputs=(*self.outputs, Output(field, f, name)))

    def measurement(self) -> Measurement:
        return Measurement(self.target, "time", self.group_by, tuple(o.name for o in self.outputs))

    def apply(self, df: DataFrame, m: Measurement, times: TimeRange | None = None) -> DataFrame:
        """``time, tags.., outputs..`` of the buckets in range. Works on streams too."""
        if not self.outputs:
            raise InvalidQuery("a rollup needs an output")
        if times is not None and (condition := in_range(times, "time", m.date)) is not None:
            df = df.filter(condition)
        types = dict(df.dtypes)
        columns = [aggregate(o.function, o.field, types[o.field], "time", m.tiebreak).alias(o.name) for o in self.outputs]
        return df.groupBy(time_bucket("time", self.every).alias("time"), *self.group_by).agg(*columns)
