"""F1-F8: predicates. All cut-offs are constants, so they are pushed to the scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions.timefn import parse_interval, resolve_as_of, ts_literal

# Fixed values of the reference: row limits (default, cap) per request kind.
TICK_LIMIT = (100, 1000)
DEPTH_LIMIT = (50, 500)
CONSOLE_TICK_LIMIT = (20, None)


def by_symbol(df: DataFrame, symbol: str, col: str = "symbol") -> DataFrame:
    """the argument is upper-cased, the stored value is not."""
    return df.filter(F.col(col) == F.lit(symbol.upper()))


def recent(df: DataFrame, interval: str | dt.timedelta, as_of: dt.datetime | None = None,
           ts_col: str = "timestamp") -> DataFrame:
    """strictly newer than ``as_of - interval``."""
    anchor = resolve_as_of(df, as_of, ts_col)
    if anchor is None:
        return df.limit(0)
    return df.filter(F.col(ts_col) > ts_literal(anchor - parse_interval(interval)))


def older_than(df: DataFrame, cutoff: dt.datetime, ts_col: str = "timestamp") -> DataFrame:
    """strictly older than the cut-off."""
    return df.filter(F.col(ts_col) < ts_literal(cutoff))


def since(df: DataFrame, start: dt.datetime, ts_col: str = "timestamp") -> DataFrame:
    """strictly after an absolute time."""
    return df.filter(F.col(ts_col) > ts_literal(start))


def select_range(df: DataFrame, symbol: str | None = None, days: float | None = 1,
                 as_of: dt.datetime | None = None, ts_col: str = "timestamp") -> DataFrame:
    """optional symbol and optional window, composed only when given."""
    if symbol:
        df = by_symbol(df, symbol)
    if days is not None:
        df = recent(df, dt.timedelta(days=days), as_of, ts_col)
    return df


def split_sides(df: DataFrame, side_col: str = "side") -> tuple[DataFrame, DataFrame]:
    """(bids, asks)."""
    return df.filter(F.col(side_col) == "B"), df.filter(F.col(side_col) == "S")


def clamp_limit(limit: int | None, default: int, cap: int | None) -> int:
    """F8: default when absent, capped from above, rejected below 1."""
    n = default if limit is None else int(limit)
    if n < 1:
        raise ValueError("limit must be at least 1")
    return min(n, cap) if cap else n
