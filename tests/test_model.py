from datetime import datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.errors import InvalidQuery
from tidemark.functions.aggregates import Function, default_alias
from tidemark.functions.durations import duration_micros, micros, timestamp
from tidemark.model import QueryBuilder, TimeRange


@pytest.mark.parametrize(
    "text,seconds",
    [("1h", 3600), ("5 minutes", 300), ("30s", 30), ("1 hour", 3600), ("2 hrs", 7200), ("1w", 604800), ("90 secs", 90), ("1h30m", 5400), ("7d", 604800), ("1000ms", 1)],
)
def test_durations(text, seconds):
    assert duration_micros(text) == seconds * 1_000_000


@pytest.mark.parametrize("text", ["", "h", "5 parsecs", "0s", "10ns", "-1h", "1.5h"])
def test_bad_durations(text):
    with pytest.raises(InvalidQuery):
        duration_micros(text)


def test_timestamps():
    assert timestamp("2024-01-01") == datetime(2024, 1, 1)
    assert timestamp("2024-01-01 02:03:04") == timestamp("2024-01-01T02:03:04Z") == timestamp("2024-01-01T03:03:04+01:00") == datetime(2024, 1, 1, 2, 3, 4)
    assert timestamp("1609459200000000000") == timestamp(1609459200000000000) == datetime(2021, 1, 1)
    with pytest.raises(InvalidQuery):
        timestamp("soon")


@given(st.integers(-(10**15), 10**15))
def test_micros_round_trip(us):
    assert micros(datetime(1970, 1, 1) + timedelta(microseconds=us)) == us


def test_function_names():
    assert Function.parse("AVERAGE") == Function("mean")
    assert Function.parse("p95") == Function.parse("percentile_95") == Function("percentile", 95)
    assert default_alias("usage", Function.parse("p95")) == "usage_percentile(95)"
    for bad in ("p101", "median", ""):
        with pytest.raises(InvalidQuery):
            Function.parse(bad)


def test_validation():
    with pytest.raises(InvalidQuery):
        TimeRange.of("2024-01-02", "2024-01-01")
    with pytest.raises(InvalidQuery):
        QueryBuilder("").build()
    with pytest.raises(InvalidQuery):
        QueryBuilder("cpu").count().every("1m", fill=True).build()
    with pytest.raises(InvalidQuery):
        QueryBuilder("cpu").group_by("host").build()
