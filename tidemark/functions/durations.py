"""One parser for durations and timestamp literals, for SQL, requests and policies."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from ..errors import InvalidQuery

# Unit names and their microseconds (nanoseconds apart).
_MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
_WORDS = {
    "us": "us µs μs microsecond microseconds usec usecs", "ms": "ms msec msecs millisecond milliseconds", "s": "s sec secs second seconds",
    "m": "m min mins minute minutes", "h": "h hr hrs hour hours", "d": "d day days", "w": "w wk wks week weeks",
}
_UNITS = {word: unit for unit, words in _WORDS.items() for word in words.split()}
_NANOS = {"ns", "nsec", "nsecs", "nanosecond", "nanoseconds"}
_PART = re.compile(r"\s*([0-9]+)\s*([A-Za-zµμ]+)")
_EPOCH = datetime(1970, 1, 1)


def duration_micros(text: str) -> int:
    """``1h``, ``5 minutes``, ``1h30m`` in microseconds; positive, in whole microseconds."""
    at, total = 0, 0
    text = text.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise InvalidQuery(f"not a duration: {text!r}")
        n, unit = int(m.group(1)), m.group(2).lower()
        if unit in _NANOS:
            if n % 1000:
                raise InvalidQuery(f"finer than a microsecond: {text!r}")
            total += n // 1000
        elif unit in _UNITS:
            total += n * _MICROS[_UNITS[unit]]
        else:
            raise InvalidQuery(f"unknown unit {m.group(2)!r} in {text!r}")
        at = m.end()
    if total <= 0:
        raise InvalidQuery(f"a duration must be positive: {text!r}")
    return total


def interval_text(micros: int) -> str:
    """An interval string that Spark reads back as so many microseconds."""
    return f"{micros} microseconds"


def timestamp(value: datetime | int | str) -> datetime:
    """A UTC timestamp without zone. Integers, and strings of digits, are epoch nanoseconds."""
    if isinstance(value, datetime):
        return value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value
    if isinstance(value, int) or re.fullmatch(r"-?[0-9]+", value.strip()):
        return _EPOCH + timedelta(microseconds=int(value) // 1000)
    try:
        return timestamp(datetime.fromisoformat(value.strip()))
    except ValueError:
        raise InvalidQuery(f"not a timestamp: {value!r}") from None


def micros(value: datetime) -> int:
    return (value - _EPOCH) // timedelta(microseconds=1)
