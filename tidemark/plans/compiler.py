"""Query to DataFrame. Only the logical plan is stated here; Catalyst does the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..functions.aggregates import aggregate, present
from ..functions.buckets import gap_fill, time_bucket
from ..model import Measurement, Query
from ..operators.filters import in_range, to_column
from ..operators.percentiles import exact_percentiles
from ..operators.windows import apply_window, ordering


def compile_query(q: Query, m: Measurement, df: DataFrame) -> DataFrame:
    """``q`` over ``df``, a DataFrame marked by ``m``.

    Order of evaluation is that of SQL: filter, group, windows, order, offset and limit.
    """
    q.validate()
    types = dict(df.dtypes)
    for condition in (in_range(q.range, "time", m.date), to_column(q.filter)):
        if condition is not None:
            df = df.filter(condition)
    out = _aggregated(q, m, df, types) if q.aggregates else df
    for call in q.windows:
        out = apply_window(out, call)
    if not q.aggregates:
        out = _projected(q, m, out)
    return _limited(q, m, out)


def _aggregated(q: Query, m: Measurement, df: DataFrame, types: dict[str, str]) -> DataFrame:
    for tag in q.group_by:
        if tag not in types:
            raise InvalidQuery(f"no column {tag!r} to group by")
    columns, percentiles = [], {}
    # Groups of a bounded time span are gathered; whole series are not.
    apart = q.every is None and not df.isStreaming
    for a in q.aggregates:
        if a.field != "*" and a.field not in types:
            raise InvalidQuery(f"no column {a.field!r} to aggregate")
        if apart and a.function.name == "percentile" and a.field != "*":
            percentiles.setdefault(a.field, {})[a.name] = a.function.percent / 100
            continue
        columns.append(aggregate(a.function, a.field, types.get(a.field, ""), "time", m.tiebreak).alias(a.name))
    keys = [F.col(t) for t in q.group_by]
    if q.every is not None:
        origin = q.origin or q.range.start
        keys.insert(0, time_bucket("time", q.every, origin).alias("time"))
        out = df.groupBy(*keys).agg(*columns)
        if q.gap_fill:
            counts = [a.name for a in q.aggregates if a.function.name == "count"]
            out = gap_fill(out, "time", q.every, q.range.start, q.range.end, q.group_by, counts, origin)
        return out
    if not percentiles:
        return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)
    # Each part gives its columns of a group; the first one knows all groups.
    out = df.groupBy(*keys).agg(*columns or [F.first(F.lit(None)).alias("_")])
    for name, wanted in percentiles.items():
        out = out.unionByName(exact_percentiles(df, q.group_by, present(F.col(name), types[name]).cast("double"), wanted), allowMissingColumns=True)
    return out.groupBy(*keys).agg(*[F.first(F.col(f"`{a.name}`"), ignorenulls=True).alias(a.name) for a in q.aggregates])


def _projected(q: Query, m: Measurement, df: DataFrame) -> DataFrame:
    names = ["time", *m.tags, *(q.fields or m.fields), *[w.name for w in q.windows]]
    for name in names:
        if name not in df.columns:
            raise InvalidQuery(f"no column {name!r} in {m.name}")
    hidden = [c for c in (*m.tiebreak, *[k for k, _ in q.order_by]) if c in df.columns and c not in names]
    return df.select(*dict.fromkeys([*names, *hidden])) if hidden and q.limit is not None else df.select(*dict.fromkeys(names))


def _limited(q: Query, m: Measurement, df: DataFrame) -> DataFrame:
    """ORDER BY as asked; with LIMIT alone, by time. Ties go by the tiebreak, so that LIMIT is deterministic."""
    order = q.order_by
    if not order and (q.limit is not None or q.offset) and "time" in df.columns:
        order = (("time", True),)
    if order:
        given = {c for c, _ in order}
        rest = [c for c in ((*q.group_by, "time") if q.aggregates else m.tiebreak) if c in df.columns and c not in given]
        df = df.orderBy(*ordering([*order, *[(c, True) for c in rest]]))
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    extra = [c for c in (*m.tiebreak, *[k for k, _ in q.order_by]) if c in df.columns]
    wanted = {"time", *m.tags, *(q.fields or m.fields), *[w.name for w in q.windows]}
    return df.drop(*[c for c in extra if c not in wanted]) if not q.aggregates else df
