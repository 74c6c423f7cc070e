"""Tag filters to columns.

Filters are two-valued: a missing tag is unequal to every value, so that ``ne`` and ``not_in``
hold for it, under NOT too. Every leaf is made null-safe before it is combined.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..model import And, Filter, Not, Or, Tag, TimeRange

# Operator spellings of filter requests.
OPERATORS = {
    "eq": "eq", "=": "eq", "equals": "eq", "neq": "ne", "ne": "ne", "!=": "ne", "not_equals": "ne", "in": "in", "not_in": "not_in", "regex": "regex", "=~": "regex", "exists": "exists",
}


def _valid_pattern(pattern: str) -> bool:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return True
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return False
    return True


def to_column(condition: Filter | None) -> Column | None:
    """The condition as a boolean column without nulls; None where it filters nothing."""
    match condition:
        case None:
            return None
        case And(parts) | Or(parts):
            found = [c for p in parts if (c := to_column(p)) is not None]
            if not found:
                return None
            return reduce(and_ if isinstance(condition, And) else or_, found)
        case Not(part):
            inner = to_column(part)
            return F.lit(False) if inner is None else ~inner
        case Tag(tag, "eq", value):
            return F.col(tag).eqNullSafe(F.lit(value)) if value is not None else F.lit(False)
        case Tag(tag, "ne", value):
            return ~F.col(tag).eqNullSafe(F.lit(value))
        case Tag(tag, "in", values):
            return F.coalesce(F.col(tag).isin(list(values)), F.lit(False)) if values else F.lit(False)
        case Tag(tag, "not_in", values):
            return F.coalesce(~F.col(tag).isin(list(values)), F.lit(True)) if values else F.lit(True)
        case Tag(tag, "regex", pattern):
            return F.coalesce(F.col(tag).rlike(pattern), F.lit(False)) if _valid_pattern(pattern) else F.lit(False)
        case Tag(tag, "exists", _):
            return F.col(tag).isNotNull()
    raise InvalidQuery(f"not a filter: {condition!r}")


def from_request(node) -> Filter | None:
    """A filter from its JSON form.

    Either ``{"tag", "op", "value"}``, or ``{"and": [...]}``, ``{"or": [...]}``, ``{"not": ...}``.
    """
    if node is None:
        return None
    if not isinstance(node, dict):
        raise InvalidQuery(f"a filter is an object: {node!r}")
    for key, kind in (("and", And), ("or", Or)):
        if key in node:
            return kind(tuple(from_request(x) for x in node[key]))
    if "not" in node:
        return Not(from_request(node["not"]))
    if "tag" not in node:
        raise InvalidQuery(f"a filter names a tag, and, or or not: {node!r}")
    op = OPERATORS.get(str(node.get("op", "eq")).lower())
    if op is None:
        raise InvalidQuery(f"unknown filter operator: {node.get('op')!r}")
    value = node.get("value", node.get("values"))
    if op in ("in", "not_in"):
        if not isinstance(value, list):
            raise InvalidQuery(f"{op} takes a list")
        value = tuple(map(str, value))
    elif op != "exists":
        if not isinstance(value, str):
            raise InvalidQuery(f"{op} takes a string")
    return Tag(node["tag"], op, value if op != "exists" else None)


def in_range(times: TimeRange, time: str = "time", date: str | None = None) -> Column | None:
    """start <= time < end, and the same bounds on the partition date, which prunes directories."""
    parts = []
    if times.start is not None:
        parts.append(F.col(time) >= F.lit(times.start).cast("timestamp_ntz"))
        if date:
            parts.append(F.col(date) >= F.lit(times.start.date()))
    if times.end is not None:
        parts.append(F.col(time) < F.lit(times.end).cast("timestamp_ntz"))
        if date:
            parts.append(F.col(date) <= F.lit(times.end.date()))
    return reduce(and_, parts) if parts else None
