"""Time helpers: the ``as_of`` anchor, interval literals, text formats.

Every ``NOW()`` of a query becomes an explicit ``as_of``. When the caller does
not pass one, it is the newest timestamp of the input (one small aggregate).
Cut-offs are built as constant literals so they reach the Parquet scan as
pushed filters and prune row groups / date partitions.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, functions as F

# Text formats that keep microseconds in JSON/CSV round trips (default writers
# cut timestamps to milliseconds).
NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
LTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
TEXT_TS_OPTIONS = {"timestampNTZFormat": NTZ_FORMAT, "timestampFormat": LTZ_FORMAT}

_UNITS = {
    "microsecond": "microseconds", "millisecond": "milliseconds", "second": "seconds",
    "minute": "minutes", "hour": "hours", "day": "days", "week": "weeks",
}


def parse_interval(text: str | dt.timedelta) -> dt.timedelta:
    """'24 hours', '1 minute', '10 seconds', '3 days' -> timedelta."""
    if isinstance(text, dt.timedelta):
        return text
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-zA-Z]+?)s?\s*", text)
    if not m or m.group(2).lower() not in _UNITS:
        raise ValueError(f"unsupported interval: {text!r}")
    return dt.timedelta(**{_UNITS[m.group(2).lower()]: float(m.group(1))})


def interval_micros(text: str | dt.timedelta) -> int:
    delta = parse_interval(text)
    return (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds


def ts_literal(value: dt.datetime) -> Column:
    """A TIMESTAMP_NTZ constant (string cast: independent of the session zone)."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def event_time(text: Column) -> Column:
    """ISO text -> TIMESTAMP_NTZ in UTC: an offset is applied, text without one is UTC, anything else is NULL."""
    zoned = text.rlike(r":\d{2}(\.\d+)?\s*([zZ]|[+-]\d{2}(:?\d{2})?)$")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    utc = F.timestamp_add("MICROSECOND", F.unix_micros(text.try_cast("timestamp")), epoch)
    return F.when(zoned, utc).otherwise(text.try_cast("timestamp_ntz"))


def resolve_as_of(df: DataFrame, as_of: dt.datetime | None = None,
                  ts_col: str = "timestamp") -> dt.datetime | None:
    """The time anchor: the caller's value, else max(ts_col) of ``df``."""
    if as_of is not None:
        return as_of
    return df.agg(F.max(ts_col).alias("m")).first()["m"]


def micros_between(start: Column | str, end: Column | str) -> Column:
    """end - start in microseconds (works on TIMESTAMP and TIMESTAMP_NTZ)."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("MICROSECOND", s, e)


def iso(col: Column | str) -> Column:
    """ISO-8601 text with microseconds, as the API's ``isoformat()``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, NTZ_FORMAT)


def period_start(ts: Column | str, period: str) -> Column:
    """Start of the fixed-length period (aligned to the epoch) containing ``ts``."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.window(c, period).start


def human_size(bytes_col: Column | str) -> Column:
    """Human-readable size ('12.3 MB'), as the monitor prints table sizes."""
    b = F.col(bytes_col) if isinstance(bytes_col, str) else bytes_col
    fmt = lambda div, unit: F.concat(F.format_number(b / F.lit(div), 1), F.lit(" " + unit))
    return (F.when(b < 1024, F.concat(b.cast("string"), F.lit(" bytes")))
            .when(b < 1024 ** 2, fmt(1024, "kB"))
            .when(b < 1024 ** 3, fmt(1024 ** 2, "MB"))
            .when(b < 1024 ** 4, fmt(1024 ** 3, "GB"))
            .otherwise(fmt(1024 ** 4, "TB")))
