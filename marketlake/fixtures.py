"""Market-data views over the driver's tables (FIXTURES.md part B).

Every view is a projection of a stored table, so its work grows with the
table. The same definitions exist as DuckDB SQL in ``plans.oracle_views``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .functions.timefn import ts_literal
from .sources.tables import read_table


def _k(props: str = "props"):
    return F.get_json_object(F.col(props), "$.k").cast("int")


def ticks(spark: SparkSession, base: str) -> DataFrame:
    return ticks_from(read_table(spark, base, "events"))


def ticks_from(ev: DataFrame) -> DataFrame:
    """The ``ticks`` projection of an events frame (batch or stream)."""
    et = F.col("event_type")
    side = F.col("user_id") % 3
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.upper(et).alias("symbol"),
        F.when(et == "view", "NYMEX").when(et == "purchase", "COMEX")
         .when(et == "signup", "CBOT").otherwise("CME").alias("exchange"),
        F.col("value").cast("decimal(20,8)").alias("price"),
        _k().alias("size"),
        F.when(side == 0, "BUY").when(side == 1, "SELL").alias("aggressor_side"),
        F.col("event_id").cast("string").alias("trade_id"),
    )


def trades(spark: SparkSession, base: str) -> DataFrame:
    """Every row of the feed is a trade."""
    return ticks(spark, base)


def quotes(spark: SparkSession, base: str) -> DataFrame:
    return quotes_from(ticks(spark, base))


def quotes_from(t: DataFrame) -> DataFrame:
    """Every row of the feed is also a quote, up to five minutes later: a
    0.50-wide market around the price."""
    half = F.lit(0.25).cast("decimal(20,8)")
    later = F.timestamp_add("SECOND", F.col("id") % 300, F.col("timestamp"))
    return t.select(
        "id", later.alias("timestamp"), "symbol", "exchange",
        (F.col("price") - half).cast("decimal(20,8)").alias("bid_price"),
        (F.col("price") + half).cast("decimal(20,8)").alias("ask_price"),
        F.col("size").alias("bid_size"),
        (F.col("size") + 1).alias("ask_size"),
    )


def depth(spark: SparkSession, base: str, since: dt.datetime | None = None) -> DataFrame:
    """``since`` bounds the raw event time, which the scan can push down; a
    depth time is the start of its event's day, so no later depth row is lost."""
    ev = read_table(spark, base, "events")
    return depth_from(ev if since is None else ev.filter(F.col("ts") >= ts_literal(since)))


def depth_from(ev: DataFrame) -> DataFrame:
    """The ``depth`` projection of an events frame (batch or stream)."""
    et = F.col("event_type")
    k = _k()
    return ev.select(
        F.col("event_id").alias("id"),
        F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("timestamp"),
        F.upper(et).alias("symbol"),
        F.when(et == "view", "NYMEX").when(et == "purchase", "COMEX")
         .when(et == "signup", "CBOT").otherwise("CME").alias("exchange"),
        F.when(F.floor(F.col("user_id") / 10) % 2 == 0, "B").otherwise("S").alias("side"),
        (F.col("user_id") % 10 + 1).cast("int").alias("level"),
        F.col("value").cast("decimal(20,8)").alias("price"),
        k.alias("size"),
        (k % 7 + 1).alias("order_count"),
        # Book message: rows of 20 consecutive event ids on the same symbol and
        # day form one message, so a snapshot never exceeds 20 rows.
        F.expr("event_id div 20").alias("msg_id"),
    )


# Fixed fixture rows (FIXTURES.md): the symbol dimension; IDLE has no ticks.
SYMBOL_ROWS = [
    (1, "CLICK", "CME", "click feed", True),
    (2, "VIEW", "NYMEX", "view feed", True),
    (3, "PURCHASE", "COMEX", "purchase feed", True),
    (4, "SIGNUP", "CBOT", "signup feed", False),
    (5, "ERROR", "CME", "error feed", True),
    (6, "IDLE", "CME", "no ticks", True),
]


def symbols(spark: SparkSession, base: str | None = None) -> DataFrame:
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("symbol", T.StringType()),
        T.StructField("exchange", T.StringType()), T.StructField("description", T.StringType()),
        T.StructField("active", T.BooleanType()),
    ])
    created = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return (spark.createDataFrame(SYMBOL_ROWS, schema)
            .withColumn("created_at", created).withColumn("updated_at", created))


def order_updates(spark: SparkSession, base: str) -> DataFrame:
    li = read_table(spark, base, "lineitem")
    action = F.when(F.col("l_linestatus") == "F", "FILL").otherwise("MODIFY")
    size = F.col("l_quantity").cast("int")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_linenumber").alias("seq"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.when(F.col("l_returnflag") == "R", "S").otherwise("B").alias("side"),
        F.col("l_extendedprice").cast("decimal(20,8)").alias("price"),
        size.alias("size"),
        action.alias("action"),
        F.when(action == "FILL", size).alias("fill_size"),
        F.when(action == "FILL", F.lit(0)).otherwise(size).alias("remaining_size"),
    )


def metrics(spark: SparkSession, base: str) -> DataFrame:
    """Long metrics table: ticks per symbol and hour as metric 'recent_ticks'."""
    t = ticks(spark, base)
    return (t.groupBy(F.col("symbol").alias("entity"),
                      F.date_trunc("hour", F.col("timestamp")).cast("timestamp_ntz").alias("ts"))
            .agg(F.count(F.lit(1)).cast("double").alias("value"))
            .withColumn("metric", F.lit("recent_ticks"))
            .select("entity", "ts", "metric", "value"))


def requests(spark: SparkSession, base: str) -> DataFrame:
    """Subscription requests: every (symbol, exchange) seen, plus one repeat."""
    pairs = ticks(spark, base).select("symbol", "exchange").distinct()
    repeat = pairs.filter(F.col("symbol") == "CLICK")
    return pairs.unionByName(repeat)


def heavy_ticks(spark: SparkSession, base: str) -> DataFrame:
    """Join-heavy variant: lineitem x part as ticks (symbol = brand)."""
    li = read_table(spark, base, "lineitem")
    part = read_table(spark, base, "part")
    j = li.join(part, li.l_partkey == part.p_partkey)
    side = F.when(F.col("l_returnflag") == "R", "SELL").when(F.col("l_returnflag") == "A", "BUY")
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("p_brand").alias("symbol"),
        F.col("l_extendedprice").cast("decimal(20,8)").alias("price"),
        F.col("l_quantity").cast("int").alias("size"),
        side.alias("aggressor_side"),
    )
