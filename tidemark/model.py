"""Data model: measurements, time ranges, filters and queries.

A measurement is a DataFrame with one time column, string tag columns that tell its series
apart, and typed field columns. Roles are kept in column metadata.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import InvalidQuery
from .functions.aggregates import Function, default_alias
from .functions.durations import duration_micros, timestamp


@dataclass(frozen=True)
class TimeRange:
    """Half open: start <= time < end; None is unbounded."""

    start: datetime | None = None
    end: datetime | None = None

    def __post_init__(self) -> None:
        if self.start is not None and self.end is not None and self.start >= self.end:
            raise InvalidQuery(f"empty time range: {self.start} to {self.end}")

    @classmethod
    def of(cls, start=None, end=None) -> TimeRange:
        return cls(None if start is None else timestamp(start), None if end is None else timestamp(end))


@dataclass(frozen=True)
class Measurement:
    """Names and roles of a table's columns.

    ``tiebreak`` orders rows of equal time; ``date`` names a partition column derived from
    the time, if the table has one.
    """

    name: str
    time: str = "time"
    tags: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    tiebreak: tuple[str, ...] = ()
    date: str | None = None

    def mark(self, df: DataFrame) -> DataFrame:
        """``df`` with the time column called ``time``, and roles in the metadata."""
        columns = [F.col(self.time).alias("time", metadata={"role": "time"})]
        columns += [F.col(t).cast("string").alias(t, metadata={"role": "tag"}) for t in self.tags]
        columns += [F.col(f).alias(f, metadata={"role": "field"}) for f in self.fields]
        known = {self.time, *self.tags, *self.fields}
        columns += [F.col(c) for c in (*self.tiebreak, *([self.date] if self.date else [])) if c not in known]
        return df.select(*columns)

    @classmethod
    def of(cls, name: str, df: DataFrame) -> Measurement:
        """Roles read back from the metadata of a marked DataFrame."""
        role = {f.name: f.metadata.get("role") for f in df.schema.fields}
        by = lambda r: tuple(n for n, x in role.items() if x == r)
        return cls(name, (by("time") or ("time",))[0], by("tag"), by("field"))


# --- filters over tags: two-valued, a missing tag is just another value ------------------


@dataclass(frozen=True)
class Tag:
    """``op``: eq, ne, in, not_in, regex, exists."""

    tag: str
    op: str
    value: str | tuple[str, ...] | None = None


@dataclass(frozen=True)
class And:
    parts: tuple = ()


@dataclass(frozen=True)
class Or:
    parts: tuple = ()


@dataclass(frozen=True)
class Not:
    part: object


Filter = Tag | And | Or | Not


@dataclass(frozen=True)
class Aggregate:
    field: str
    function: Function
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or default_alias("count" if self.field == "*" else self.field, self.function)


@dataclass(frozen=True)
class Frame:
    """Bounds relative to the current row; None is unbounded. ``kind``: rows or range."""

    kind: str = "range"
    start: int | None = None
    end: int | None = 0


@dataclass(frozen=True)
class WindowCall:
    """row_number, rank, dense_rank, lag, lead, or an aggregate's name, over a window."""

    function: str
    field: str = "*"
    partition_by: tuple[str, ...] = ()
    order_by: tuple[tuple[str, bool], ...] = ()  # (column, ascending)
    frame: Frame | None = None
    offset: int = 1
    default: object = None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or f"{self.function.lower()}_over"


@dataclass(frozen=True)
class Query:
    """What to compute over one measurement."""

    measurement: str
    range: TimeRange = field(default_factory=TimeRange)
    filter: Filter | None = None
    fields: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    group_by: tuple[str, ...] = ()
    every: int | None = None  # microseconds
    origin: datetime | None = None
    gap_fill: bool = False
    windows: tuple[WindowCall, ...] = ()
    order_by: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None
    offset: int = 0

    def validate(self) -> Query:
        if not self.measurement:
            raise InvalidQuery("a query needs a measurement")
        if self.gap_fill and (self.every is None or self.range.start is None or self.range.end is None):
            raise InvalidQuery("a gap fill needs a bucket width and a bounded range")
        if (self.every or self.group_by) and not self.aggregates:
            raise InvalidQuery("grouping needs an aggregate")
        if (self.limit is not None and self.limit < 0) or self.offset < 0:
            raise InvalidQuery("LIMIT and OFFSET can't be negative")
        return self


class QueryBuilder:
    """Fluent construction: ``QueryBuilder("cpu").between(a, b).where_eq("host", "s1").mean("usage").every("5m").build()``."""

    def __init__(self, measurement: str):
        self._q = Query(measurement)
        self._where: list[Filter] = []

    def _set(self, **changes) -> QueryBuilder:
        self._q = replace(self._q, **changes)
        return self

    def between(self, start=None, end=None) -> QueryBuilder:
        return self._set(range=TimeRange.of(start, end))

    def where(self, condition: Filter) -> QueryBuilder:
        self._where.append(condition)
        return self

    def where_eq(self, tag: str, value: str) -> QueryBuilder:
        return self.where(Tag(tag, "eq", value))

    def where_ne(self, tag: str, value: str) -> QueryBuilder:
        return self.where(Tag(tag, "ne", value))

    def where_in(self, tag: str, values: Sequence[str]) -> QueryBuilder:
        return self.where(Tag(tag, "in", tuple(values)))

    def where_not_in(self, tag: str, values: Sequence[str]) -> QueryBuilder:
        return self.where(Tag(tag, "not_in", tuple(values)))

    def where_regex(self, tag: str, pattern: str) -> QueryBuilder:
        return self.where(Tag(tag, "regex", pattern))

    def where_exists(self, tag: str) -> QueryBuilder:
        return self.where(Tag(tag, "exists"))

    def select(self, *fields: str) -> QueryBuilder:
        return self._set(fields=self._q.fields + fields)

    def aggregate(self, function: str, field: str, alias: str | None = None) -> QueryBuilder:
        return self._set(aggregates=(*self._q.aggregates, Aggregate(field, Function.parse(function), alias)))

    def mean(self, field: str, alias: str | None = None) -> QueryBuilder:
        return self.aggregate("mean", field, alias)

    def count(self, field: str = "*", alias: str | None = None) -> QueryBuilder:
        return self.aggregate("count", field, alias)

    def group_by(self, *tags: str) -> QueryBuilder:
        return self._set(group_by=self._q.group_by + tags)

    def every(self, width: str, fill: bool = False, origin: datetime | str | None = None) -> QueryBuilder:
        return self._set(every=duration_micros(width), gap_fill=fill, origin=None if origin is None else timestamp(origin))

    def over(self, call: WindowCall) -> QueryBuilder:
        return self._set(windows=(*self._q.windows, call))

    def order_by(self, column: str, ascending: bool = True) -> QueryBuilder:
        return self._set(order_by=(*self._q.order_by, (column, ascending)))

    def limit(self, n: int, offset: int = 0) -> QueryBuilder:
        return self._set(limit=n, offset=offset)

    def build(self) -> Query:
        where = None if not self._where else self._where[0] if len(self._where) == 1 else And(tuple(self._where))
        return replace(self._q, filter=where).validate()
