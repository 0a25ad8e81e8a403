"""Mergeable partial aggregates of bars and volume profiles.

A batch of ticks is reduced to one row per key (``partial``); partials of any
batches merge into the result of all their rows (``merge``, ``final``), in any
order and any split: counts and sums add up, extremes are extremes of
extremes, and the first and last price keep the (time, id) that decides them.
Stored by batch, they make a result that can be refreshed from new batches
alone and corrected by rows that come late, without reading old ticks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timefn import parse_interval
from .flow import price_level


def _side_sum(side: str) -> Column:
    return F.sum(F.when(F.col("aggressor_side") == side, F.col("size").cast("bigint")).otherwise(0))


def _window(ts: Column, period: str) -> Column:
    return F.window(ts, period)


@dataclass(frozen=True)
class Rollup:
    """``keys`` of a result row, aggregates of raw rows, aggregates that merge them, and the columns handed out.

    Every key set holds ``period_start`` and ``period_end``."""

    period: str
    other_keys: dict[str, Column]
    rows: dict[str, Column]
    merged: dict[str, Callable[[str], Column]]
    shown: Callable[[DataFrame], DataFrame]

    @property
    def keys(self) -> list[str]:
        return ["symbol", "period_start", "period_end", *self.other_keys]

    def keyed(self, ticks: DataFrame) -> DataFrame:
        """``ticks`` with the key columns of the result row they count in."""
        w = _window(F.col("timestamp"), self.period)
        return (ticks.withColumn("_w", w).withColumns(self.other_keys)
                .withColumn("period_start", F.col("_w.start")).withColumn("period_end", F.col("_w.end")).drop("_w"))

    def partial(self, ticks: DataFrame) -> DataFrame:
        return self.keyed(ticks).groupBy(*self.keys).agg(*[c.alias(n) for n, c in self.rows.items()])

    def merge(self, partials: DataFrame) -> DataFrame:
        return partials.groupBy(*self.keys).agg(*[how(n).alias(n) for n, how in self.merged.items()])

    def final(self, partials: DataFrame) -> DataFrame:
        return self.shown(self.merge(partials))


def bars(period: str = "1 minute") -> Rollup:
    """OHLCV bars with order flow; the columns of ``flow.build_bars``."""
    edge = F.struct("timestamp", "id", "price")
    minutes = int(parse_interval(period).total_seconds() // 60)

    def shown(df: DataFrame) -> DataFrame:
        return df.select(F.col("period_start").alias("timestamp"), "symbol", F.col("first.price").alias("open_price"), "high_price",
                         "low_price", F.col("last.price").alias("close_price"), "volume", "trade_count", "buy_volume", "sell_volume",
                         (F.col("buy_volume") - F.col("sell_volume")).alias("delta"), F.lit(minutes).alias("period_minutes"))
    return Rollup(period, {}, {
        "first": F.min(edge), "last": F.max(edge), "high_price": F.max("price"), "low_price": F.min("price"),
        "volume": F.sum(F.col("size").cast("bigint")), "trade_count": F.count(F.lit(1)),
        "buy_volume": _side_sum("BUY"), "sell_volume": _side_sum("SELL"),
    }, {"first": F.min, "last": F.max, "high_price": F.max, "low_price": F.min, "volume": F.sum, "trade_count": F.sum,
        "buy_volume": F.sum, "sell_volume": F.sum}, shown)


def profile(period: str = "1 hour", tick_size: Decimal | float | int = 1) -> Rollup:
    """Volume at price; the columns of ``flow.build_volume_profile``."""
    side = F.col("aggressor_side")
    sums = ("buy_volume", "sell_volume", "total_volume", "buy_trades", "sell_trades")

    def shown(df: DataFrame) -> DataFrame:
        return df.select(F.col("period_start").alias("timestamp"), "symbol", "price_level", *sums,
                         (F.col("buy_volume") - F.col("sell_volume")).alias("delta"), "period_start", "period_end")
    return Rollup(period, {"price_level": price_level("price", tick_size)}, {
        "buy_volume": _side_sum("BUY"), "sell_volume": _side_sum("SELL"), "total_volume": F.sum(F.col("size").cast("bigint")),
        "buy_trades": F.count_if(side == "BUY"), "sell_trades": F.count_if(side == "SELL"),
    }, {n: F.sum for n in sums}, shown)


def activity(pane: str) -> Rollup:
    """T4: ticks, highest price and newest time per pane."""
    shown = lambda df: df.withColumnsRenamed({"period_start": "window_start", "period_end": "window_end"})
    return Rollup(pane, {}, {"tick_count": F.count(F.lit(1)), "max_price": F.max("price"), "last_update": F.max("timestamp")},
                  {"tick_count": F.sum, "max_price": F.max, "last_update": F.max}, shown)


def levels(pane: str, lg_k: int = 12) -> Rollup:
    """Updates and a sketch of the distinct book levels per pane. With ``lg_k`` 12 the relative standard error is
    1.6 %; few distinct values are counted exactly."""
    shown = lambda df: df.withColumn("distinct_levels", F.hll_sketch_estimate("sketch")).drop("sketch")
    return Rollup(pane, {}, {"updates": F.count(F.lit(1)), "sketch": F.hll_sketch_agg("level", lg_k)},
                  {"updates": F.sum, "sketch": F.hll_union_agg}, shown)


def sliding(rollup: Rollup, panes: DataFrame, window: str, slide: str) -> DataFrame:
    """Merged partials of sliding windows from the (merged) panes of ``rollup``; the pane must divide window and slide."""
    spread = panes.withColumn("_w", F.window("period_start", window, slide))
    spread = spread.drop("period_start", "period_end").withColumn("period_start", F.col("_w.start")).withColumn(
        "period_end", F.col("_w.end")).drop("_w")
    return rollup.merge(spread)
