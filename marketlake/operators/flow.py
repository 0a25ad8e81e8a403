"""Order-flow tables: A13 volume profile, A14-A17 bars (market_stats), A9/A10
profile summaries, A19 order life cycle, W6 running delta, J7 as-of quotes.

Bars and profiles are ``groupBy(symbol, window)`` aggregates; ``min_by`` /
``max_by`` / sums all combine map-side, so the shuffle carries one partial row
per (task, symbol, bar) whatever the skew. W6 and J7 are order-dependent and
use the range-partitioned helpers of ``functions.sequence``.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sequence import last_non_null, running_sum
from ..functions.timefn import interval_micros, parse_interval
from .filters import by_symbol, recent
from .normalize import with_signed_volume

def _buy() -> Column:
    return F.col("aggressor_side") == "BUY"


def _sell() -> Column:
    return F.col("aggressor_side") == "SELL"


def _period(ts: str, period: str) -> Column:
    return F.window(F.col(ts), period)


def _minutes(period: str) -> int:
    return int(parse_interval(period).total_seconds() // 60)


def price_level(price: Column | str, tick_size: Decimal | float | int = 1) -> Column:
    p = F.col(price) if isinstance(price, str) else price
    tick = F.lit(Decimal(str(tick_size)))
    return (F.floor(p / tick) * tick).cast("decimal(20,8)")


def build_volume_profile(ticks: DataFrame, period: str = "1 hour",
                         tick_size: Decimal | float | int = 1) -> DataFrame:
    """Volume at price per (symbol, period, price level). Ticks with no
    aggressor count in ``total_volume`` only; delta = buy - sell."""
    size = F.col("size").cast("bigint")
    g = ticks.groupBy("symbol", _period("timestamp", period).alias("w"),
                      price_level("price", tick_size).alias("price_level"))
    out = g.agg(
        F.sum(F.when(_buy(), size).otherwise(0)).alias("buy_volume"),
        F.sum(F.when(_sell(), size).otherwise(0)).alias("sell_volume"),
        F.sum(size).alias("total_volume"),
        F.count_if(_buy()).alias("buy_trades"),
        F.count_if(_sell()).alias("sell_trades"),
    )
    return out.select(
        F.col("w.start").alias("timestamp"), "symbol", "price_level",
        "buy_volume", "sell_volume", "total_volume", "buy_trades", "sell_trades",
        (F.col("buy_volume") - F.col("sell_volume")).alias("delta"),
        F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"))


def volume_profile_summary(vp: DataFrame, as_of: dt.datetime | None = None,
                           interval: str = "1 day") -> DataFrame:
    """The summary view - last day by (symbol, price level)."""
    return recent(vp, interval, as_of).groupBy("symbol", "price_level").agg(
        F.sum("buy_volume").alias("total_buy_volume"),
        F.sum("sell_volume").alias("total_sell_volume"),
        F.sum("total_volume").alias("total_volume"),
        (F.sum("buy_volume") - F.sum("sell_volume")).alias("total_delta"))


def volume_profile_export(vp: DataFrame, days: float = 1, symbol: str | None = None,
                          as_of: dt.datetime | None = None) -> DataFrame:
    """A10: export query - n days, optional symbol."""
    src = by_symbol(vp, symbol) if symbol else vp
    return recent(src, dt.timedelta(days=days), as_of).groupBy("symbol", "price_level").agg(
        F.sum("buy_volume").alias("buy_vol"), F.sum("sell_volume").alias("sell_vol"),
        F.sum(F.col("buy_volume") - F.col("sell_volume")).alias("delta"))


def build_bars(ticks: DataFrame, period: str = "1 minute") -> DataFrame:
    """A14 (+A16): OHLCV bars with order flow. Open/close are the first/last
    price by (timestamp, id)."""
    order = F.struct("timestamp", "id")
    size = F.col("size").cast("bigint")
    out = ticks.groupBy("symbol", _period("timestamp", period).alias("w")).agg(
        F.min_by("price", order).alias("open_price"),
        F.max("price").alias("high_price"),
        F.min("price").alias("low_price"),
        F.max_by("price", order).alias("close_price"),
        F.sum(size).alias("volume"),
        F.count(F.lit(1)).alias("trade_count"),
        F.sum(F.when(_buy(), size).otherwise(0)).alias("buy_volume"),
        F.sum(F.when(_sell(), size).otherwise(0)).alias("sell_volume"),
    )
    return out.select(
        F.col("w.start").alias("timestamp"), "symbol", "open_price", "high_price", "low_price",
        "close_price", "volume", "trade_count", "buy_volume", "sell_volume",
        (F.col("buy_volume") - F.col("sell_volume")).alias("delta"),
        F.lit(_minutes(period)).alias("period_minutes"))


def bar_order_flow(ticks: DataFrame, period: str = "1 minute") -> DataFrame:
    """A16 on its own: buy, sell and delta per bar."""
    size = F.col("size").cast("bigint")
    out = ticks.groupBy("symbol", _period("timestamp", period).alias("w")).agg(
        F.sum(F.when(_buy(), size).otherwise(0)).alias("buy_volume"),
        F.sum(F.when(_sell(), size).otherwise(0)).alias("sell_volume"))
    return out.select(F.col("w.start").alias("timestamp"), "symbol", "buy_volume", "sell_volume",
                      (F.col("buy_volume") - F.col("sell_volume")).alias("delta"))


def bar_spread(quotes: DataFrame, period: str = "1 minute") -> DataFrame:
    """Mean ask-bid spread per bar; the sum is exact decimal, the mean
    is rounded to 6 digits."""
    spread = F.col("ask_price") - F.col("bid_price")
    out = quotes.filter(spread.isNotNull()).groupBy(
        "symbol", _period("timestamp", period).alias("w")).agg(
        F.sum(spread).alias("_s"), F.count(F.lit(1)).alias("quote_count"))
    return out.select(
        F.col("w.start").alias("timestamp"), "symbol",
        F.round(F.col("_s").cast("double") / F.col("quote_count"), 6).alias("avg_bid_ask_spread"),
        "quote_count")


def bar_depth(depth: DataFrame, period: str = "1 minute") -> DataFrame:
    """Bid and ask depth of the bar's last snapshot. Two partial
    aggregates: sizes per snapshot, then the newest snapshot per bar."""
    size = F.col("size").cast("bigint")
    snap = depth.groupBy("symbol", _period("timestamp", period).alias("w"), "timestamp").agg(
        F.sum(F.when(F.col("side") == "B", size).otherwise(0)).alias("bid"),
        F.sum(F.when(F.col("side") == "S", size).otherwise(0)).alias("ask"))
    last = snap.groupBy("symbol", "w").agg(
        F.max_by(F.struct("bid", "ask"), "timestamp").alias("_l"))
    return last.select(F.col("w.start").alias("timestamp"), "symbol",
                       F.col("_l.bid").alias("total_bid_depth"),
                       F.col("_l.ask").alias("total_ask_depth"))


def market_stats(ticks: DataFrame, quotes: DataFrame | None = None,
                 depth: DataFrame | None = None, period: str = "1 minute") -> DataFrame:
    """A14-A17 combined into the ``market_stats`` table. The joins are between
    bar-level aggregates (one row per symbol and bar), never raw rows."""
    out = build_bars(ticks, period)
    if quotes is not None:
        out = out.join(bar_spread(quotes, period).drop("quote_count"), ["symbol", "timestamp"], "left")
    else:
        out = out.withColumn("avg_bid_ask_spread", F.lit(None).cast("double"))
    if depth is not None:
        out = out.join(bar_depth(depth, period), ["symbol", "timestamp"], "left")
    else:
        out = (out.withColumn("total_bid_depth", F.lit(None).cast("bigint"))
                  .withColumn("total_ask_depth", F.lit(None).cast("bigint")))
    return out


def order_state(updates: DataFrame) -> DataFrame:
    """Per order - update count, last action, filled and remaining size."""
    # (order_id, seq) need not be unique: price completes the order.
    order = (F.struct("timestamp", "seq", "price") if "seq" in updates.columns
             else F.struct("timestamp", "id"))
    return updates.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("updates"),
        F.max_by("action", order).alias("last_action"),
        F.coalesce(F.sum(F.col("fill_size").cast("bigint")), F.lit(0).cast("bigint")).alias("filled_size"),
        F.max_by("remaining_size", order).alias("remaining_size"),
        F.max("timestamp").alias("last_update"))


def running_delta(ticks: DataFrame) -> DataFrame:
    """Cumulative buy - sell volume per symbol in (timestamp, id) order.
    Two-level prefix sum (see ``functions.sequence``): no task holds a whole symbol."""
    signed = with_signed_volume(ticks).select(
        "id", "timestamp", "symbol", (F.col("buy_volume") - F.col("sell_volume")).cast("bigint").alias("signed_volume"))
    out = running_sum(signed, ["symbol"], ["timestamp", "id"], "signed_volume", "running_delta")
    return out.select("id", "timestamp", "symbol", "signed_volume", "running_delta")


def asof_quotes(trades: DataFrame, quotes: DataFrame, tolerance: str | None = None) -> DataFrame:
    """Each trade with the newest quote of its symbol at or before it.

    Trades and quotes are unioned and a forward fill carries the last quote
    (a quote sorts before a trade at the same time). The fill runs over rows
    range-partitioned by symbol and time, with the carry between partitions from
    a summary, so a hot symbol spreads over many tasks and both inputs are
    scanned once. ``tolerance`` drops matches older
    than the given interval (NULL quote columns, as a left as-of join).
    """
    qcols = ["bid_price", "ask_price", "bid_size", "ask_size"]
    q = quotes.select("symbol", "timestamp", "id", F.lit(0).alias("_kind"),
                      F.struct(F.col("timestamp").alias("quote_timestamp"), *qcols).alias("_q"))
    tcols = [c for c in trades.columns if c not in ("symbol", "timestamp", "id")]
    t = trades.select("symbol", "timestamp", "id", F.lit(1).alias("_kind"),
                      F.lit(None).cast(q.schema["_q"].dataType).alias("_q"),
                      F.struct(*tcols).alias("_t"))
    u = t.unionByName(q, allowMissingColumns=True)
    filled = last_non_null(u, ["symbol"], ["timestamp", "_kind", "id"], "_q", "_match")
    out = filled.filter(F.col("_kind") == 1).select(
        "id", "timestamp", "symbol", *[F.col(f"_t.{c}").alias(c) for c in tcols],
        *[F.col(f"_match.{c}").alias(c) for c in ["quote_timestamp", *qcols]])
    if tolerance is not None:
        stale = F.timestamp_diff("MICROSECOND", F.col("quote_timestamp"), F.col("timestamp")) \
            > F.lit(interval_micros(tolerance))
        out = out.withColumn("_stale", F.coalesce(stale, F.lit(False)))
        for c in ["quote_timestamp", *qcols]:
            out = out.withColumn(c, F.when(F.col("_stale"), F.lit(None)).otherwise(F.col(c)))
        out = out.drop("_stale")
    return out
