"""Window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..functions.aggregates import Function, aggregate_over
from ..model import WindowCall

RANKING = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}
SHIFTS = {"lag": F.lag, "lead": F.lead}


def ordering(keys) -> list[Column]:
    """Missing values come first in ascending and last in descending order."""
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in keys]


def window_spec(call: WindowCall, time: str = "time"):
    """Without ORDER BY, functions of order go by time, and aggregates take the whole partition."""
    name = call.function.lower()
    order = call.order_by or (((time, True),) if name in RANKING or name in SHIFTS or call.frame else ())
    spec = Window.partitionBy(*call.partition_by)
    if order:
        spec = spec.orderBy(*ordering(order))
    if call.frame and name not in RANKING and name not in SHIFTS:
        lo = Window.unboundedPreceding if call.frame.start is None else call.frame.start
        hi = Window.unboundedFollowing if call.frame.end is None else call.frame.end
        spec = spec.rowsBetween(lo, hi) if call.frame.kind == "rows" else spec.rangeBetween(lo, hi)
    return spec


def apply_window(df: DataFrame, call: WindowCall, time: str = "time") -> DataFrame:
    """``df`` with the call's column; other columns stay."""
    name, spec = call.function.lower(), window_spec(call, time)
    if name in RANKING:
        column = RANKING[name]().over(spec).cast("bigint")
    elif name in SHIFTS:
        if call.field not in df.columns:
            raise InvalidQuery(f"{name} needs a column, not {call.field!r}")
        column = SHIFTS[name](F.col(call.field), call.offset, call.default).over(spec)
    else:
        dtype = dict(df.dtypes).get(call.field, "bigint")
        column = aggregate_over(Function.parse(name), call.field, dtype, spec)
    return df.withColumn(call.name, column)
