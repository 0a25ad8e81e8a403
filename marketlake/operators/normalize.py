"""Raw messages to table rows, and table rows to responses.

All projections: no shuffle, fully code-generated, applied per micro-batch in
streams exactly as in batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exchange import with_exchange
from ..functions.timefn import event_time, iso


def _c(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """A field of a loosely-typed message, NULL when the message lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def _arrival(arrival: Column | str | None) -> Column:
    if arrival is None:
        return F.localtimestamp()
    return F.col(arrival) if isinstance(arrival, str) else arrival


def normalize_ticks_v1(raw: DataFrame, arrival: Column | str | None = None) -> DataFrame:
    """Library tick dict -> v1 row. Time is the arrival time.

    Missing price/size become 0; any aggressor other than 1 is a sell.
    """
    return raw.select(
        _arrival(arrival).cast("timestamp_ntz").alias("timestamp"),
        F.coalesce(_c(raw, "symbol"), F.lit("")).alias("symbol"),
        F.coalesce(_c(raw, "last_trade_price").try_cast("double"), F.lit(0.0)).alias("price"),
        F.coalesce(_c(raw, "last_trade_size").try_cast("double").try_cast("int"), F.lit(0)).alias("volume"),
        F.when(_c(raw, "aggressor_side", "int") == 1, "buy").otherwise("sell").alias("direction"),
        F.coalesce(_c(raw, "trade_type"), F.lit("")).alias("trade_type"),
        F.coalesce(_c(raw, "exchange"), F.lit("")).alias("exchange"),
    )


def normalize_ticks(msg: DataFrame, arrival: Column | str | None = None,
                    default_exchange: str = "CME") -> DataFrame:
    """JSON tick message -> v2 tick row.

    Event time from the ISO text (an offset is converted to UTC), else arrival
    time; exchange defaults to CME; a number out of range is NULL;
    price through its decimal text; a zero or missing bid/ask is NULL.
    """
    ts = event_time(_c(msg, "timestamp"))
    return msg.select(
        *([F.col("id")] if "id" in msg.columns else []),
        F.coalesce(ts, _arrival(arrival).cast("timestamp_ntz")).alias("timestamp"),
        _c(msg, "symbol").alias("symbol"),
        F.coalesce(_c(msg, "exchange"), F.lit(default_exchange)).alias("exchange"),
        F.coalesce(_c(msg, "price", "double"), F.lit(0.0)).try_cast("decimal(20,8)").alias("price"),
        F.coalesce(_c(msg, "size", "int"), F.lit(0)).alias("size"),
        F.nullif(_c(msg, "bid_price", "double"), F.lit(0.0)).try_cast("decimal(20,8)").alias("bid_price"),
        F.nullif(_c(msg, "ask_price", "double"), F.lit(0.0)).try_cast("decimal(20,8)").alias("ask_price"),
        _c(msg, "bid_size", "int").alias("bid_size"),
        _c(msg, "ask_size", "int").alias("ask_size"),
        *([_c(msg, "aggressor_side").alias("aggressor_side")] if "aggressor_side" in msg.columns else []),
        *([_c(msg, "trade_id").alias("trade_id")] if "trade_id" in msg.columns else []),
    )


def normalize_ticks_strict(decoded: DataFrame, arrival: Column | str | None = None,
                           prefix_map=None) -> DataFrame:
    """Binary-path tick. Rows without symbol or price are dropped;
    the exchange comes from the symbol's root (J6); aggressor 1 -> BUY,
    any other value -> SELL, absent -> NULL. A price that is no number of the
    table's range (NaN, infinite, too large) is dropped like a missing one."""
    price = F.col("price").try_cast("double").try_cast("decimal(20,8)")
    kept = with_exchange(decoded.filter(F.col("symbol").isNotNull() & price.isNotNull()),
                         "symbol", "_exchange", prefix_map)
    aggr = _c(kept, "aggressor", "int")
    return kept.select(
        *([F.col("id")] if "id" in kept.columns else []),
        F.coalesce(_c(kept, "timestamp", "timestamp_ntz"),
                   _arrival(arrival).cast("timestamp_ntz")).alias("timestamp"),
        F.col("symbol"),
        F.col("_exchange").alias("exchange"),
        F.col("price").cast("double").try_cast("decimal(20,8)").alias("price"),
        F.coalesce(_c(kept, "size", "int").try_cast("int"), F.lit(0)).alias("size"),
        F.nullif(_c(kept, "bid_price", "double"), F.lit(0.0)).try_cast("decimal(20,8)").alias("bid_price"),
        F.nullif(_c(kept, "ask_price", "double"), F.lit(0.0)).try_cast("decimal(20,8)").alias("ask_price"),
        _c(kept, "bid_size", "int").alias("bid_size"),
        _c(kept, "ask_size", "int").alias("ask_size"),
        F.when(aggr.isNull(), F.lit(None).cast("string"))
         .when(aggr == 1, "BUY").otherwise("SELL").alias("aggressor_side"),
        _c(kept, "trade_id").alias("trade_id"),
    )


def normalize_quotes(msg: DataFrame, arrival: Column | str | None = None,
                     default_exchange: str = "CME") -> DataFrame:
    """Quote message -> own ``quotes`` row (never a price-0 tick)."""
    ts = event_time(_c(msg, "timestamp"))
    return msg.select(
        *([F.col("id")] if "id" in msg.columns else []),
        F.coalesce(ts, _arrival(arrival).cast("timestamp_ntz")).alias("timestamp"),
        _c(msg, "symbol").alias("symbol"),
        F.coalesce(_c(msg, "exchange"), F.lit(default_exchange)).alias("exchange"),
        F.nullif(_c(msg, "bid_price", "double"), F.lit(0.0)).try_cast("decimal(20,8)").alias("bid_price"),
        F.nullif(_c(msg, "ask_price", "double"), F.lit(0.0)).try_cast("decimal(20,8)").alias("ask_price"),
        _c(msg, "bid_size", "int").alias("bid_size"),
        _c(msg, "ask_size", "int").alias("ask_size"),
    )


def to_v1_ticks(df: DataFrame) -> DataFrame:
    """v2 tick columns as the v1 readers expect them."""
    return df.select(
        *([F.col("id")] if "id" in df.columns else []),
        "timestamp", "symbol",
        F.col("price").cast("double").alias("price"),
        F.col("size").alias("volume"),
        F.coalesce(F.lower(_c(df, "aggressor_side")), F.lit("sell")).alias("direction"),
        _c(df, "trade_type").alias("trade_type"),
        _c(df, "exchange").alias("exchange"),
    )


def with_signed_volume(df: DataFrame, side_col: str = "aggressor_side",
                       size_col: str = "size") -> DataFrame:
    """Per-tick buy/sell volume (0 for the other side and for unknown)."""
    side = F.col(side_col)
    return (df.withColumn("buy_volume", F.when(side == "BUY", F.col(size_col)).otherwise(F.lit(0)))
              .withColumn("sell_volume", F.when(side == "SELL", F.col(size_col)).otherwise(F.lit(0))))


def shape_rows(df: DataFrame) -> DataFrame:
    """Response shaping - ISO time text, money as double, empty arrays, depth 0."""
    cols = []
    for f in df.schema.fields:
        name, t = f.name, f.dataType.simpleString()
        if t.startswith("timestamp"):
            cols.append(iso(name).alias(name))
        elif t.startswith("decimal"):
            cols.append(F.col(name).cast("double").alias(name))
        elif name in ("bids", "asks"):
            cols.append(F.coalesce(F.col(name), F.array().cast(f.dataType)).alias(name))
        elif name == "depth":
            cols.append(F.coalesce(F.col(name), F.lit(0)).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def with_thousands(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counts as text with thousands separators (console tables)."""
    for c in cols:
        df = df.withColumn(c, F.format_number(F.col(c), 0))
    return df


def to_json_rows(df: DataFrame, col: str = "json") -> DataFrame:
    """N11 response body: each shaped row as one JSON object."""
    return shape_rows(df).select(F.to_json(F.struct("*")).alias(col))


def parse_symbols(df: DataFrame, col: str = "symbols", default_exchange: str = "CME") -> DataFrame:
    """N13: 'ES:CME, nq' -> rows (symbol, exchange): split on commas, trim, drop
    empties, upper-case, split an optional ':EXCHANGE' (default CME)."""
    item = F.upper(F.trim(F.col("_item")))
    parts = F.split(item, ":")
    exch = F.element_at(parts, 2)
    return (df.select(F.explode(F.split(F.col(col), ",")).alias("_item"))
              .select(item.alias("_item"))
              .filter(F.col("_item") != "")
              .select(F.trim(F.element_at(parts, 1)).alias("symbol"),
                      F.when(F.size(parts) > 1, F.trim(exch)).otherwise(F.lit(default_exchange))
                       .alias("exchange")))
