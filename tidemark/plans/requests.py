"""Queries from JSON-style requests."""

from __future__ import annotations

from ..errors import InvalidQuery
from ..functions.aggregates import Function
from ..functions.durations import duration_micros
from ..model import Aggregate, And, Query, Tag, TimeRange
from ..operators.filters import from_request

_KNOWN = {
    "measurement", "time_range", "tags", "filter", "fields", "aggregate", "aggregates", "group_by", "group_by_time", "gap_fill", "order_by", "limit", "offset",
}


def query_from_request(request: dict) -> Query:
    """``{"measurement", "time_range": {"start", "end"}, "tags": {..}, "filter": .., "aggregate": {"field", "function", "alias"}, ..}``.

    Tags and filter are both required to hold. With an aggregate, ``fields`` is ignored.
    """
    if unknown := set(request) - _KNOWN:
        raise InvalidQuery(f"unknown keys: {', '.join(sorted(unknown))}")
    times = request.get("time_range") or {}
    parts = [Tag(k, "eq", v) for k, v in (request.get("tags") or {}).items()]
    if (condition := from_request(request.get("filter"))) is not None:
        parts.append(condition)
    asked = [*(request.get("aggregates") or []), *([request["aggregate"]] if request.get("aggregate") else [])]
    aggregates = tuple(Aggregate(a["field"], Function.parse(a["function"]), a.get("alias")) for a in asked)
    width = request.get("group_by_time")
    return Query(
        measurement=request.get("measurement", ""), range=TimeRange.of(times.get("start"), times.get("end")), filter=And(tuple(parts)) if parts else None,
        fields=() if aggregates else tuple(request.get("fields") or ()), aggregates=aggregates, group_by=tuple(request.get("group_by") or ()),
        every=duration_micros(width) if width else None, gap_fill=bool(request.get("gap_fill")),
        order_by=tuple((c, str(d).lower() != "desc") for c, d in (request.get("order_by") or [])), limit=request.get("limit"), offset=request.get("offset") or 0,
    ).validate()
