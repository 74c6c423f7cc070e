"""The ten aggregates, as columns.

NaN counts as missing. SUM, MEAN, MIN and MAX are doubles. FIRST and LAST go by time, and by
the tiebreak columns where times are equal. The deviation of a single value is 0.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidQuery

# Accepted names.
NAMES = {
    "count": "count", "sum": "sum", "mean": "mean", "avg": "mean", "average": "mean", "min": "min", "max": "max", "first": "first", "last": "last",
    "stddev": "stddev", "stddev_samp": "stddev", "std_dev": "stddev", "variance": "variance", "var_samp": "variance", "var": "variance",
}
_PERCENTILE = re.compile(r"(?:percentile_?|p)\(?([0-9]{1,3})\)?")


@dataclass(frozen=True)
class Function:
    """An aggregate by its canonical name; ``percent`` for percentiles."""

    name: str
    percent: int | None = None

    @classmethod
    def parse(cls, text: str) -> Function:
        text = text.strip().lower()
        if text in NAMES:
            return cls(NAMES[text])
        if (m := _PERCENTILE.fullmatch(text)) and int(m.group(1)) <= 100:
            return cls("percentile", int(m.group(1)))
        raise InvalidQuery(f"unknown aggregate: {text!r}")

    @property
    def label(self) -> str:
        return f"percentile({self.percent})" if self.percent is not None else self.name


def default_alias(field: str, function: Function) -> str:
    return f"{field}_{function.label}".lower()


def present(column: Column, dtype: str) -> Column:
    """The column with NaN as null."""
    return F.when(~F.isnan(column), column) if dtype in ("double", "float") else column


def _single_is_zero(value: Column, n: Column) -> Column:
    return F.when(n == 1, F.lit(0.0)).otherwise(value)


def aggregate(function: Function, field: str, dtype: str, time: str = "time", tiebreak: Sequence[str] = ()) -> Column:
    """Aggregate of ``field`` (``*`` with count: of rows)."""
    if field == "*":
        if function.name != "count":
            raise InvalidQuery(f"{function.label}(*) means nothing")
        return F.count("*")
    value = present(F.col(field), dtype)
    number = value.cast("double")
    match function.name:
        case "count":
            return F.count(value)
        case "sum":
            return F.sum(number)
        case "mean":
            return F.avg(number)
        case "min":
            return F.min(number)
        case "max":
            return F.max(number)
        case "first" | "last":
            by = F.min_by if function.name == "first" else F.max_by
            order = F.struct(time, *tiebreak) if tiebreak else F.col(time)
            return by(value, F.when(value.isNotNull(), order))
        case "stddev":
            return _single_is_zero(F.stddev_samp(number), F.count(number))
        case "variance":
            return _single_is_zero(F.var_samp(number), F.count(number))
        case "percentile":
            return F.percentile(number, function.percent / 100)
    raise InvalidQuery(f"unknown aggregate: {function.name!r}")


def aggregate_over(function: Function, field: str, dtype: str, window) -> Column:
    """The aggregate over a window; FIRST and LAST go by the frame's order."""
    if field == "*":
        return F.count("*").over(window)
    value = present(F.col(field), dtype)
    number = value.cast("double")
    match function.name:
        case "first":
            return F.first(value, ignorenulls=True).over(window)
        case "last":
            return F.last(value, ignorenulls=True).over(window)
        case "stddev":
            return _single_is_zero(F.stddev_samp(number).over(window), F.count(number).over(window))
        case "variance":
            return _single_is_zero(F.var_samp(number).over(window), F.count(number).over(window))
    return aggregate(function, field, dtype).over(window)
