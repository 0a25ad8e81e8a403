"""Counts, activity and freshness statistics.

Each statistic is one aggregate per table: the reference's separate
COUNT/MIN/MAX/recent queries are fused into a single scan with ``count_if``.
All aggregates are partial (map-side) aggregates, so a hot symbol costs one
partial row per task, not a skewed task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.timefn import parse_interval, resolve_as_of, ts_literal
from .filters import recent


def _union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: (table_name, row_count)."""
    return _union_all([df.agg(F.count(F.lit(1)).alias("row_count"))
                         .select(F.lit(name).alias("table_name"), "row_count")
                       for name, df in tables.items()])


def symbol_stats(ticks: DataFrame) -> DataFrame:
    """A2: per symbol: tick count, first and last tick."""
    return ticks.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("tick_count"),
        F.min("timestamp").alias("first_tick"),
        F.max("timestamp").alias("last_tick"),
    )


def table_stats(df: DataFrame, name: str, as_of: dt.datetime | None = None,
                recent_interval: str = "1 hour", ts_col: str = "timestamp") -> DataFrame:
    """A3+A4 fused: count, distinct symbols, time range and recent rows in one scan."""
    anchor = resolve_as_of(df, as_of, ts_col)
    cutoff = ts_literal(anchor - parse_interval(recent_interval)) if anchor else F.lit(None)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.countDistinct("symbol").alias("unique_symbols"),
        F.min(ts_col).alias("earliest"),
        F.max(ts_col).alias("latest"),
        F.count_if(F.col(ts_col) > cutoff).alias("recent_rows"),
    ).select(F.lit(name).alias("table_name"), "*")


def recent_counts(tables: Mapping[str, DataFrame], as_of: dt.datetime,
                  interval: str = "1 hour", ts_col: str = "timestamp") -> DataFrame:
    """A4: rows newer than ``as_of - interval`` per table."""
    cutoff = ts_literal(as_of - parse_interval(interval))
    return _union_all([df.agg(F.count_if(F.col(ts_col) > cutoff).alias("recent_rows"))
                         .select(F.lit(name).alias("table_name"), "recent_rows")
                       for name, df in tables.items()])


def tick_activity(ticks: DataFrame, as_of: dt.datetime | None = None,
                  interval: str = "24 hours") -> DataFrame:
    """A5: last-24h ticks by (symbol, exchange)."""
    return recent(ticks, interval, as_of).groupBy("symbol", "exchange").agg(
        F.count(F.lit(1)).alias("tick_count"), F.max("timestamp").alias("last_update"))


def depth_activity(depth: DataFrame, as_of: dt.datetime | None = None,
                   interval: str = "24 hours") -> DataFrame:
    """Last-24h depth rows by symbol."""
    return recent(depth, interval, as_of).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("level2_count"), F.max("timestamp").alias("last_update"))


def live_tick_stats(ticks: DataFrame, as_of: dt.datetime | None = None,
                    interval: str = "1 minute") -> DataFrame:
    """Recent activity per symbol. ``max_price`` is what the console labels
    last price; ``last_price`` is the price of the newest tick."""
    return recent(ticks, interval, as_of).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("tick_count"),
        F.max("price").alias("max_price"),
        F.max_by("price", F.struct("timestamp", "id")).alias("last_price"),
        F.max("timestamp").alias("last_update"),
    )


def live_depth_levels(depth: DataFrame, as_of: dt.datetime | None = None,
                      interval: str = "10 seconds") -> DataFrame:
    """Distinct book levels per symbol in the recent window."""
    return recent(depth, interval, as_of).groupBy("symbol").agg(
        F.countDistinct("level").alias("distinct_levels"),
        F.count(F.lit(1)).alias("updates"))


def status_counts(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """COUNT(*) FILTER (WHERE col = v) for each value, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  *[F.count_if(F.col(col) == v).alias(f"{v.lower()}_count") for v in values])


def freshness(tables: Mapping[str, DataFrame | None], as_of: dt.datetime,
              interval: str = "5 minutes", ts_col: str = "timestamp") -> DataFrame:
    """A table is healthy when it has a row newer than ``as_of - interval``;
    a missing table (``None``) is reported unhealthy."""
    cutoff = ts_literal(as_of - parse_interval(interval))
    present = {n: df for n, df in tables.items() if df is not None}
    spark = next(iter(present.values())).sparkSession
    parts = [df.agg((F.count_if(F.col(ts_col) > cutoff) > 0).alias("healthy"))
               .select(F.lit(name).alias("table_name"), "healthy") for name, df in present.items()]
    missing = [n for n, df in tables.items() if df is None]
    if missing:
        parts.append(spark.createDataFrame([(n, False) for n in missing], "table_name string, healthy boolean"))
    return _union_all(parts)
