"""Calendar arithmetic that agrees with SQL's boundary-crossing differences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ConfigError

# Seconds of each unit; months and years by their longest.
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2678400, "quarter": 8035200, "year": 31622400}
_ALIASES = {"s": "second", "sec": "second", "min": "minute", "h": "hour", "hr": "hour", "d": "day", "w": "week", "mon": "month", "y": "year", "yr": "year"}


def truncated(grain: str, column: Column) -> Column:
    """The start of the period that a timestamp is in, without a time zone."""
    return F.date_trunc(grain, column).cast("timestamp_ntz")


def boundary_diff(unit: str, start: Column, end: Column) -> Column:
    """How many unit boundaries lie between two timestamps; weeks are whole sevens of calendar days, toward zero."""
    if unit == "year":
        out = F.year(end) - F.year(start)
    elif unit == "quarter":
        out = (F.year(end) * 4 + F.quarter(end)) - (F.year(start) * 4 + F.quarter(start))
    elif unit == "month":
        out = (F.year(end) * 12 + F.month(end)) - (F.year(start) * 12 + F.month(start))
    elif unit == "week":
        out = (F.datediff(end.cast("date"), start.cast("date")) / 7).cast("bigint")
    elif unit == "day":
        out = F.datediff(end.cast("date"), start.cast("date"))
    else:
        raise ConfigError(f"no difference in {unit!r}")
    return out.cast("bigint")


def interval(text: str) -> tuple[int, str]:
    """(number, unit) of an interval such as "7 days"."""
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]+?)s?\s*", text or "")
    unit = m and _ALIASES.get(m[2].lower(), m[2].lower())
    if not m or unit not in UNIT_SECONDS or int(m[1]) == 0:
        raise ConfigError(f"not an interval: {text!r}")
    return int(m[1]), unit


def seconds_at_most(text: str) -> int:
    """An upper bound of an interval's length in seconds."""
    n, unit = interval(text)
    return n * UNIT_SECONDS[unit]


def interval_sql(text: str) -> str:
    n, unit = interval(text)
    if unit == "quarter":
        n, unit = 3 * n, "month"
    return f"INTERVAL {n} {unit.upper()}"
