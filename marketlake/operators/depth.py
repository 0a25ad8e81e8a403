"""Order-book operators: N5-N8 (wide/long shapes), W1 current book,
J3 latest snapshot, W5 depth time-to-live.

Per-symbol maxima are computed as a tiny aggregate and joined back on
(symbol[, timestamp]) instead of a window over ``partitionBy(symbol)``, so a
hot symbol is never held by one task; AQE broadcasts the aggregate once its
measured size is known to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timefn import event_time, interval_micros

MAX_LEVELS = 10  # fixed value of the reference: levels kept per side


def _levels(arr: Column, max_levels: int | None) -> Column:
    arr = F.coalesce(arr, F.array())
    return F.slice(arr, 1, max_levels) if max_levels else arr


def to_wide_depth(raw: DataFrame, arrival: Column | str | None = None,
                  max_levels: int = MAX_LEVELS) -> DataFrame:
    """Depth message -> one wide row; level = position + 1; size and
    num_orders default 0; depth = number of kept levels."""
    def side(name: str) -> Column:
        if name not in raw.columns:
            return F.array().cast("array<struct<level:int,price:double,size:int,num_orders:int>>")
        return F.transform(_levels(F.col(name), max_levels), lambda x, i: F.struct(
            (i + 1).cast("int").alias("level"),
            F.coalesce(x["price"].cast("double"), F.lit(0.0)).alias("price"),
            F.coalesce(x["size"].try_cast("int"), F.lit(0)).alias("size"),
            F.coalesce(x["num_orders"].cast("int"), F.lit(0)).alias("num_orders")))
    ts = (F.localtimestamp() if arrival is None else
          (F.col(arrival) if isinstance(arrival, str) else arrival))
    out = raw.select(
        ts.cast("timestamp_ntz").alias("timestamp"),
        F.coalesce(F.col("symbol"), F.lit("")).alias("symbol"),
        F.coalesce(F.col("update_type") if "update_type" in raw.columns else F.lit(None).cast("string"),
                   F.lit("")).alias("update_type"),
        side("bids").alias("bids"), side("asks").alias("asks"))
    return out.withColumn("depth", (F.size("bids") + F.size("asks")).cast("int"))


def to_long_depth(raw: DataFrame, max_levels: int | None = MAX_LEVELS,
                  default_exchange: str = "CME", order_count_default: int | None = None,
                  arrival: Column | str | None = None) -> DataFrame:
    """Depth message -> one row per (side, level). The JSON path keeps
    ``max_levels`` per side and stores no order count; the binary path keeps
    all levels with order count default 1 (``max_levels=None, order_count_default=1``).
    Both sides go through one ``inline`` - a single pass over the message."""
    def tagged(name: str, side: str) -> Column:
        arr = _levels(F.col(name), max_levels)
        def one(x, i):
            oc = (F.coalesce(x["order_count"].try_cast("int"), F.lit(order_count_default))
                  if order_count_default is not None else F.lit(None).cast("int"))
            return F.struct(F.lit(side).alias("side"), (i + 1).cast("int").alias("level"),
                            F.coalesce(x["price"].cast("double"), F.lit(0.0))
                             .try_cast("decimal(20,8)").alias("price"),
                            F.coalesce(x["size"].try_cast("int"), F.lit(0)).alias("size"),
                            oc.alias("order_count"))
        return F.transform(arr, one)
    ts = event_time(raw["timestamp"]) if "timestamp" in raw.columns else F.lit(None)
    arr_ts = F.localtimestamp() if arrival is None else (F.col(arrival) if isinstance(arrival, str) else arrival)
    exch = F.col("exchange") if "exchange" in raw.columns else F.lit(None).cast("string")
    base = raw.select(
        F.coalesce(ts, arr_ts.cast("timestamp_ntz")).alias("timestamp"),
        F.col("symbol"),
        F.coalesce(exch, F.lit(default_exchange)).alias("exchange"),
        F.concat(tagged("bids", "B"), tagged("asks", "S")).alias("_levels"))
    return base.select("timestamp", "symbol", "exchange", F.inline("_levels"))


def long_to_wide(depth: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """One row per snapshot with level-sorted bid and ask arrays.

    A snapshot is one message: (symbol, timestamp), and ``msg_id`` where the table has it, so the group is bounded by
    the levels of one book."""
    keys = keys or ("symbol", "timestamp", *(c for c in ("msg_id",) if c in depth.columns))
    extra = [c for c in ("id",) if c in depth.columns]
    lvl = F.struct(F.col("level"), F.col("price").cast("double").alias("price"), F.col("size"),
                   F.col("order_count").alias("num_orders"), *[F.col(c) for c in extra])
    side = F.col("side")
    out = depth.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(side == "B", lvl))).alias("bids"),
        F.sort_array(F.collect_list(F.when(side == "S", lvl))).alias("asks"))
    return out.withColumn("depth", (F.size("bids") + F.size("asks")).cast("int"))


def wide_to_long(wide: DataFrame, keys: tuple[str, ...] = ("symbol", "timestamp")) -> DataFrame:
    """Wide snapshot rows -> one row per (side, level)."""
    fields = [f.name for f in wide.schema["bids"].dataType.elementType.fields]
    def tagged(name: str, side: str) -> Column:
        return F.transform(F.coalesce(F.col(name), F.array()), lambda x: F.struct(
            F.lit(side).alias("side"), *[x[f].alias(f) for f in fields]))
    out = wide.select(*keys, F.inline(F.concat(tagged("bids", "B"), tagged("asks", "S"))))
    return (out.withColumn("price", F.col("price").cast("decimal(20,8)"))
               .withColumnRenamed("num_orders", "order_count"))


def latest_depth(depth: DataFrame, keys: tuple[str, ...] = ("symbol", "side", "level")) -> DataFrame:
    """Newest row per (symbol, side, level) - DISTINCT ON as a partial
    aggregate (``max_by`` combines map-side, unlike ``row_number``)."""
    payload = [c for c in ("price", "size", "order_count", "timestamp", "id") if c in depth.columns]
    order = F.struct("timestamp", "id") if "id" in depth.columns else F.col("timestamp")
    return (depth.groupBy(*keys).agg(F.max_by(F.struct(*payload), order).alias("_r"))
                 .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in payload]))


def latest_snapshot(depth: DataFrame, symbol: str | None = None) -> DataFrame:
    """The rows at the symbol's newest timestamp, side DESC then level."""
    src = depth.filter(F.col("symbol") == symbol.upper()) if symbol else depth
    newest = src.groupBy("symbol").agg(F.max("timestamp").alias("timestamp"))
    return (src.join(newest, ["symbol", "timestamp"], "left_semi")
               .orderBy("symbol", F.col("side").desc(), "level", "id"))


def depth_ttl(depth: DataFrame, ttl: str = "1 minute") -> DataFrame:
    """Final state of the time-to-live delete - per symbol keep rows not
    older than the symbol's newest time minus ``ttl``."""
    newest = depth.groupBy("symbol").agg(F.max("timestamp").alias("_newest"))
    keep = F.timestamp_diff("MICROSECOND", F.col("timestamp"), F.col("_newest")) <= F.lit(interval_micros(ttl))
    return depth.join(newest, "symbol").filter(keep).drop("_newest")
