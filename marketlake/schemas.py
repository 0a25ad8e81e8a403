"""Canonical table definitions (S2) and column rules.

The long ("v2") layout is canonical: one tick per row, one depth level per row.
The wide ("v1") layout is produced by adapters in ``operators.normalize``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

MONEY = T.DecimalType(20, 8)

SYMBOLS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("exchange", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("active", T.BooleanType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

TICKS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("exchange", T.StringType()),
    T.StructField("price", MONEY, False),
    T.StructField("size", T.IntegerType(), False),
    T.StructField("trade_id", T.StringType()),
    T.StructField("bid_price", MONEY),
    T.StructField("ask_price", MONEY),
    T.StructField("bid_size", T.IntegerType()),
    T.StructField("ask_size", T.IntegerType()),
    T.StructField("aggressor_side", T.StringType()),
    T.StructField("is_implied", T.BooleanType()),
    T.StructField("trade_type", T.StringType()),
    T.StructField("condition_codes", T.StringType()),
    T.StructField("buy_volume", T.IntegerType()),
    T.StructField("sell_volume", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

QUOTES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("exchange", T.StringType()),
    T.StructField("bid_price", MONEY),
    T.StructField("ask_price", MONEY),
    T.StructField("bid_size", T.IntegerType()),
    T.StructField("ask_size", T.IntegerType()),
])

DEPTH = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("exchange", T.StringType()),
    T.StructField("side", T.StringType()),
    T.StructField("level", T.IntegerType(), False),
    T.StructField("price", MONEY, False),
    T.StructField("size", T.IntegerType(), False),
    T.StructField("order_count", T.IntegerType()),
    T.StructField("implied_size", T.IntegerType()),
    T.StructField("update_type", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

ORDER_UPDATES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("exchange", T.StringType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("side", T.StringType()),
    T.StructField("price", MONEY),
    T.StructField("size", T.IntegerType()),
    T.StructField("action", T.StringType()),
    T.StructField("fill_size", T.IntegerType()),
    T.StructField("remaining_size", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

VOLUME_PROFILE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("price_level", MONEY, False),
    T.StructField("buy_volume", T.LongType()),
    T.StructField("sell_volume", T.LongType()),
    T.StructField("total_volume", T.LongType()),
    T.StructField("buy_trades", T.LongType()),
    T.StructField("sell_trades", T.LongType()),
    T.StructField("delta", T.LongType()),
    T.StructField("period_start", T.TimestampNTZType()),
    T.StructField("period_end", T.TimestampNTZType()),
])

MARKET_STATS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("open_price", MONEY),
    T.StructField("high_price", MONEY),
    T.StructField("low_price", MONEY),
    T.StructField("close_price", MONEY),
    T.StructField("volume", T.LongType()),
    T.StructField("avg_bid_ask_spread", MONEY),
    T.StructField("buy_volume", T.LongType()),
    T.StructField("sell_volume", T.LongType()),
    T.StructField("delta", T.LongType()),
    T.StructField("total_bid_depth", T.LongType()),
    T.StructField("total_ask_depth", T.LongType()),
    T.StructField("period_minutes", T.IntegerType()),
])

TICKS_V1 = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("price", T.DoubleType(), False),
    T.StructField("volume", T.IntegerType(), False),
    T.StructField("direction", T.StringType()),
    T.StructField("trade_type", T.StringType()),
    T.StructField("exchange", T.StringType()),
])

LEVEL = T.StructType([
    T.StructField("level", T.IntegerType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("num_orders", T.IntegerType()),
])

WIDE_DEPTH = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("update_type", T.StringType()),
    T.StructField("bids", T.ArrayType(LEVEL)),
    T.StructField("asks", T.ArrayType(LEVEL)),
    T.StructField("depth", T.IntegerType()),
])

# Fixed values of the reference's DDL: column defaults.
DEFAULTS = {
    "symbols": {"exchange": "CME", "active": True},
    "ticks": {"is_implied": False, "buy_volume": 0, "sell_volume": 0},
    "depth": {"implied_size": 0},
    "volume_profile": {"buy_volume": 0, "sell_volume": 0, "total_volume": 0, "buy_trades": 0, "sell_trades": 0},
    "market_stats": {"period_minutes": 1},
}

# Fixed values of the reference's DDL: NOT NULL columns and CHECK rules.
REQUIRED = {
    "symbols": ["symbol"],
    "ticks": ["timestamp", "symbol", "price", "size"],
    "depth": ["timestamp", "symbol", "level", "price", "size"],
    "order_updates": ["timestamp", "symbol"],
    "volume_profile": ["timestamp", "symbol", "price_level"],
    "market_stats": ["timestamp", "symbol"],
    "ticks_v1": ["timestamp", "symbol", "price", "volume"],
}
CHECKS = {
    "depth": {"side": ["B", "S"]},
    "order_updates": {"side": ["B", "S"]},
}

SCHEMAS = {
    "symbols": SYMBOLS, "ticks": TICKS, "quotes": QUOTES, "depth": DEPTH,
    "order_updates": ORDER_UPDATES, "volume_profile": VOLUME_PROFILE, "market_stats": MARKET_STATS,
    "ticks_v1": TICKS_V1,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: cast present columns, add missing ones as NULL."""
    cols = []
    for field in schema.fields:
        if field.name in df.columns:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*cols)


def enforce(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Apply column defaults, then split rows by NOT NULL / CHECK rules.

    Returns ``(ok, rejected)``; ``rejected`` carries a ``reject_reason`` column.
    One pass, no shuffle: the reason is a projection and the split two filters.
    """
    for name, value in DEFAULTS.get(table, {}).items():
        if name in df.columns:
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    reasons = []
    for name in REQUIRED.get(table, []):  # a column that is absent is NULL in every row
        missing = F.col(name).isNull() if name in df.columns else F.lit(True)
        reasons.append(F.when(missing, F.lit(f"{name} is null")))
    for name, allowed in CHECKS.get(table, {}).items():
        if name in df.columns:
            reasons.append(F.when(F.col(name).isNotNull() & ~F.col(name).isin(allowed),
                                  F.lit(f"{name} not in {','.join(allowed)}")))
    reason = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    tagged = df.withColumn("reject_reason", reason)
    ok = tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = tagged.filter(F.col("reject_reason").isNotNull())
    return ok, rejected


def create_table_ddl(name: str, location: str, partition_by_date: bool = True) -> str:
    """S2 as SQL: ``CREATE TABLE ... USING parquet [PARTITIONED BY (date)] LOCATION``.

    Event tables get a ``date`` partition column (derived from ``timestamp``
    on write), which turns time predicates into partition pruning.
    """
    schema = SCHEMAS[name]
    cols = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields]
    part = partition_by_date and "timestamp" in schema.fieldNames()
    if part:
        cols.append("`date` date")
    return (f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(cols)}) USING parquet"
            + (" PARTITIONED BY (`date`)" if part else "") + f" LOCATION '{location}'")
