"""Newest-N and ordered output.

``orderBy(...).limit(n)`` becomes ``TakeOrderedAndProject``: each task keeps
its own top n and only n rows per task reach the final merge, so a top-k over
100 TB moves kilobytes. The symbol predicate is pushed to the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .filters import CONSOLE_TICK_LIMIT, DEPTH_LIMIT, TICK_LIMIT, by_symbol, clamp_limit
from .normalize import to_v1_ticks


def newest(df: DataFrame, n: int, ts_col: str = "timestamp", tie: str = "id") -> DataFrame:
    keys = [F.col(ts_col).desc()] + ([F.col(tie).desc()] if tie in df.columns else [])
    return df.orderBy(*keys).limit(n)


def recent_ticks(ticks: DataFrame, symbol: str | None = None, limit: int | None = None,
                 defaults: tuple = TICK_LIMIT) -> DataFrame:
    """O1/O3: newest ticks of a symbol (or of all symbols when None)."""
    n = clamp_limit(limit, *defaults)
    src = by_symbol(ticks, symbol) if symbol else ticks
    return newest(src, n)


def api_ticks(ticks: DataFrame, symbol: str, limit: int | None = None) -> DataFrame:
    """O1 as the tick endpoint returns it: v1 columns, newest first."""
    top = recent_ticks(ticks, symbol, limit, TICK_LIMIT)
    return to_v1_ticks(top).select("id", "timestamp", "symbol", "price", "volume",
                                   "direction", "trade_type", "exchange")


def console_ticks(ticks: DataFrame, symbol: str | None = None, limit: int | None = None) -> DataFrame:
    """O3: console view with bid/ask columns; default 20 rows."""
    top = recent_ticks(ticks, symbol, limit, CONSOLE_TICK_LIMIT)
    cols = ["id", "timestamp", "symbol", "price", "size"]
    cols += [c if c in ticks.columns else F.lit(None).cast("decimal(20,8)").alias(c)
             for c in ("bid_price", "ask_price")]
    return top.select(*cols)


def recent_depth(wide: DataFrame, symbol: str, limit: int | None = None, tie: str = "id") -> DataFrame:
    """O2: newest wide depth rows of a symbol (``tie`` orders equal times)."""
    n = clamp_limit(limit, *DEPTH_LIMIT)
    return newest(by_symbol(wide, symbol), n, tie=tie)


def ordered_for_export(df: DataFrame, keys: list[str]) -> DataFrame:
    """Globally ordered output without a single-task sort.

    Range partitioning samples the keys and gives every task a contiguous key
    range; sorting inside each partition then yields part files that are in
    order when read by name.
    """
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
