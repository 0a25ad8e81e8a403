"""SQL surface: the market tables and the reference's two views as temp views,
so SQL users can query them with ``spark.sql`` (same plans as the DataFrame API)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from .. import fixtures as fx
from ..functions.timefn import resolve_as_of
from ..operators import depth as dp, flow


def register_views(spark: SparkSession, base: str, as_of: dt.datetime | None = None) -> list[str]:
    """Create temp views ``ticks, trades, quotes, depth, symbols, order_updates,
    volume_profile, latest_market_depth, volume_profile_summary``."""
    ticks = fx.ticks(spark, base)
    anchor = resolve_as_of(ticks, as_of)
    vp = flow.build_volume_profile(ticks, "1 hour")
    frames = {
        "ticks": ticks, "trades": fx.trades(spark, base), "quotes": fx.quotes(spark, base),
        "depth": fx.depth(spark, base), "symbols": fx.symbols(spark),
        "order_updates": fx.order_updates(spark, base), "volume_profile": vp,
        "latest_market_depth": dp.latest_depth(fx.depth(spark, base)),
        "volume_profile_summary": flow.volume_profile_summary(vp, anchor),
    }
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return list(frames)
