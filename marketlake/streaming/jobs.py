"""Structured Streaming operators T1-T9.

Streams carry event time as TIMESTAMP (watermarks reject TIMESTAMP_NTZ);
``to_event_time`` / ``to_table_time`` convert at the edges. Stateful
operators keep bounded state per key: the last fired time of an alert type
(the book, T5, is in ``book.py``, gaps, T7, in ``gaps.py``). Inside a
micro-batch a key's rows are sorted by time before they touch the state, so
the result does not depend on how rows arrive within a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.timefn import interval_micros
from ..operators.flow import price_level

# Fixed value of the reference: polling knob of the console (the collector's batching is in ``sources.bounded``).
LIVE_REFRESH = "2 seconds"


def stream_table(spark: SparkSession, base: str, name: str, max_files: int = 1) -> DataFrame:
    """A stored Parquet table as a stream (schema fixed from the table, no inference)."""
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", max_files).parquet(base))


def to_event_time(df: DataFrame, col: str = "timestamp") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))


def to_table_time(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def trigger_options(available_now: bool = True, interval: str = "5 seconds") -> dict:
    """Run to completion (backfill / tests) or every ``interval``."""
    return {"availableNow": True} if available_now else {"processingTime": interval}


def run_to_completion(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def drain(query) -> None:
    """Run a started query until its source has nothing more to admit, then stop it (for sources that bound a batch
    themselves, of which ``availableNow`` would run a single batch). A restarted source first offers what it admitted
    last, which may be nothing new: only the second time is nothing new the end."""
    try:
        query.processAllAvailable()
        query.processAllAvailable()
    finally:
        query.stop()
    run_to_completion(query)


def write_batch_once(batch: DataFrame, path: str, batch_id: int, partition_by: Sequence[str] = ()) -> None:
    """Write a micro-batch to its own ``batch_id`` folder of a table; a batch that
    is run again replaces its folder, so a restart adds no rows twice."""
    batch.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/batch_id={batch_id}")


# ------------------------------------------------------------------ T1 / T3

def ingest(stream: DataFrame, out: str, checkpoint: str, partition_col: str | None = "timestamp",
           available_now: bool = True):
    """Continuous append to a Parquet table (date partitions), exactly
    once through the checkpoint."""
    df = stream
    writer_cols = []
    if partition_col:
        df = df.withColumn("date", F.to_date(F.col(partition_col)))
        writer_cols = ["date"]
    w = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
           .outputMode("append").trigger(**trigger_options(available_now)))
    if writer_cols:
        w = w.partitionBy(*writer_cols)
    return w.start()


def subscribed_stream(stream: DataFrame, subscriptions: DataFrame,
                      keys: Sequence[str] = ("symbol", "exchange")) -> DataFrame:
    """J8 on a stream with subscriptions fixed at its start (a file table's
    listing is frozen then); see ``subscribed_ingest`` for a running set."""
    subs = subscriptions.select(*keys).dropDuplicates(list(keys))
    return stream.join(subs, list(keys), "left_semi")


def subscribed_ingest(stream: DataFrame, subscriptions: Callable[[], DataFrame], out: str, checkpoint: str,
                      keys: Sequence[str] = ("symbol", "exchange"), available_now: bool = True):
    """Rows of subscribed (symbol, exchange) only. ``subscriptions`` is read
    anew for every micro-batch, so a request joins the running stream."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch_once(subscribed_stream(batch, subscriptions(), keys), out, batch_id)
    return (stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
            .trigger(**trigger_options(available_now)).start())


# ------------------------------------------------------------------ T4 / T6 / T9

def live_stats_stream(ticks: DataFrame, window: str = "1 minute", watermark: str = "1 minute") -> DataFrame:
    """T4: activity per symbol and window; append mode emits a window once the
    watermark passes its end, so state stays bounded. For sliding windows, run
    it over panes and put the windows together from them
    (``operators.rollup.sliding``): a row is aggregated once. ``live.py`` has
    the view that shows open windows."""
    t = to_event_time(ticks).withWatermark("timestamp", watermark)
    out = t.groupBy(F.window("timestamp", window).alias("w"), "symbol").agg(
        F.count(F.lit(1)).alias("tick_count"), F.max("price").alias("max_price"),
        F.max("timestamp").alias("last_update"))
    out = out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                     "symbol", "tick_count", "max_price", "last_update")
    return to_table_time(out, ["window_start", "window_end", "last_update"])


def bars_stream(ticks: DataFrame, period: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """Streaming OHLCV bars; a bar is final (append) once the watermark
    passes its end."""
    t = to_event_time(ticks).withWatermark("timestamp", watermark)
    order = F.struct("timestamp", "id")
    size = F.col("size").cast("bigint")
    out = t.groupBy("symbol", F.window("timestamp", period).alias("w")).agg(
        F.min_by("price", order).alias("open_price"), F.max("price").alias("high_price"),
        F.min("price").alias("low_price"), F.max_by("price", order).alias("close_price"),
        F.sum(size).alias("volume"), F.count(F.lit(1)).alias("trade_count"),
        F.sum(F.when(F.col("aggressor_side") == "BUY", size).otherwise(0)).alias("buy_volume"),
        F.sum(F.when(F.col("aggressor_side") == "SELL", size).otherwise(0)).alias("sell_volume"))
    out = out.select(F.col("w.start").alias("timestamp"), F.col("w.end").alias("period_end"), "symbol",
                     "open_price", "high_price", "low_price", "close_price", "volume", "trade_count",
                     "buy_volume", "sell_volume",
                     (F.col("buy_volume") - F.col("sell_volume")).alias("delta"))
    return to_table_time(out, ["timestamp", "period_end"])


def profile_stream(ticks: DataFrame, period: str = "1 hour", watermark: str = "10 minutes",
                   tick_size: float | int = 1) -> DataFrame:
    """Streaming volume profile - volume and trades per symbol, period and
    price level; final (append) once the watermark passes the period's end."""
    t = to_event_time(ticks).withWatermark("timestamp", watermark)
    size, side = F.col("size").cast("bigint"), F.col("aggressor_side")
    out = t.groupBy("symbol", F.window("timestamp", period).alias("w"), price_level("price", tick_size).alias("price_level")).agg(
        F.sum(F.when(side == "BUY", size).otherwise(0)).alias("buy_volume"),
        F.sum(F.when(side == "SELL", size).otherwise(0)).alias("sell_volume"),
        F.sum(size).alias("total_volume"), F.count_if(side == "BUY").alias("buy_trades"),
        F.count_if(side == "SELL").alias("sell_trades"))
    out = out.select(F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), "symbol", "price_level",
                     "buy_volume", "sell_volume", "total_volume", "buy_trades", "sell_trades")
    return to_table_time(out, ["period_start", "period_end"])


def dedup_stream(stream: DataFrame, keys: Sequence[str], watermark: str = "1 hour") -> DataFrame:
    """Replay protection - a row whose keys were already seen within the
    watermark delay is dropped."""
    t = to_event_time(stream).withWatermark("timestamp", watermark)
    return to_table_time(t.dropDuplicatesWithinWatermark(list(keys)), ["timestamp"])


# ------------------------------------------------------------------ T8: alert cool-down

_LAST_STATE = T.StructType([T.StructField("last_us", T.LongType())])


def alert_stream(alerts: DataFrame, cooldown: str = "300 seconds", ts_col: str = "ts") -> DataFrame:
    """Greedy cool-down as keyed state (last fired time per entity and
    alert type); the streaming twin of M2. Severity, metric and value of the
    alert that fires stay with it."""
    c_us = interval_micros(cooldown)
    carried = [c for c in ("severity", "metric", "value") if c in alerts.columns]
    types = dict(alerts.dtypes)
    schema = ", ".join(["entity string", "alert_type string", *(f"{c} {types[c]}" for c in carried), "us long"])
    columns = ["entity", "alert_type", *carried, "us"]
    src = alerts.select("entity", "alert_type", *carried, F.unix_micros(F.col(ts_col).cast("timestamp")).alias("us"))

    def one_per_time(batches):
        """Alerts of one time count once: what a partition repeats does not reach the state."""
        for chunk in batches:
            yield chunk.sort_values(["us", *carried]).drop_duplicates(["entity", "alert_type", "us"])
    src = src.mapInPandas(one_per_time, src.schema)

    def step(key, batches, state):
        # one row per time: what the cool-down can choose from
        rows = None
        for chunk in batches:
            rows = chunk if rows is None else pd.concat([rows, chunk])
            rows = rows.sort_values(["us", *carried]).drop_duplicates("us")
        times = rows["us"].to_numpy()
        last, fired, i = (state.get[0] if state.exists else None), [], 0
        while True:
            i = max(i, int(np.searchsorted(times, last + c_us)) if last is not None else 0)
            if i >= len(times):
                break
            fired.append(i)
            last = int(times[i])
            i += 1
        if last is not None:
            state.update((last,))
        yield rows.iloc[fired][columns]

    out = src.groupBy("entity", "alert_type").applyInPandasWithState(step, schema, _LAST_STATE, "append", "NoTimeout")
    return out.select("entity", "alert_type", *carried, F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"))


def write_batches(stream: DataFrame, out: str, checkpoint: str, mode: str = "append",
                  available_now: bool = True, interval: str = "5 seconds", batch_column: str | None = None):
    """Run a stream into a Parquet table partitioned by micro-batch, so a batch
    run again replaces itself and update-mode outputs can be resolved to the
    newest version per key. With ``batch_column`` a micro-batch holds several
    batches of its source: each goes to its own folder, written by one task."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        if batch_column:
            write_batch_once(batch.repartition(batch_column), out, batch_id, [batch_column])
        else:
            write_batch_once(batch, out, batch_id)
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .foreachBatch(sink).trigger(**trigger_options(available_now, interval)).start())


# ------------------------------------------------------------------ T1 for the JSON feed

def ingest_feed(spark: SparkSession, source: str, out_base: str, checkpoint: str,
                available_now: bool = True, max_files: int = 1, max_bytes: int | None = None):
    """T1 + S3/S4 + N2/N4/N6: newline-delimited JSON files -> one table per
    route, in one streaming query.

    Each micro-batch is parsed once (invalid lines go to ``rejects``), routed
    by message type and written to ``ticks``, ``quotes``, ``depth``, ``log``
    and ``unknown`` under ``out_base`` (ticks/quotes/depth partitioned by
    date). A micro-batch takes ``max_files`` files or, with ``max_bytes``, as many
    as hold that many bytes (one at least): a table per route is a fixed price per
    micro-batch, so a backlog of many files is better bounded by its bytes. A message without a time gets the time its batch arrived. The parsed
    batch is persisted for the duration of the multi-sink write and released
    afterwards (a lost block is recomputed from the batch's source files). Every
    table keeps a folder per micro-batch: a batch that is run again after a
    restart replaces its own folders.
    """
    from ..operators.depth import to_long_depth
    from ..operators.normalize import normalize_quotes, normalize_ticks
    from ..sources import json_feed as jf

    bound = ("maxFilesPerTrigger", max_files) if max_bytes is None else ("maxBytesPerTrigger", max_bytes)
    lines = spark.readStream.option(*bound).text(source)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if max_bytes is not None:   # files differ in how long their lines take
            batch = batch.repartition(spark.sparkContext.defaultParallelism)
        parsed = jf.parse_tagged(batch).persist()   # each line parsed once for all sinks
        try:
            good, bad = jf.split_tagged(parsed)
            routes = jf.route(good)
            arrival = F.timestamp_add("MICROSECOND", F.unix_micros(F.current_timestamp()),
                                      F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
            tables = {
                "ticks": normalize_ticks(routes["tick"], arrival=arrival),
                "quotes": normalize_quotes(routes["quote"], arrival=arrival),
                "depth": to_long_depth(routes["depth"], arrival=arrival),
            }
            for name, df in tables.items():
                write_batch_once(df.withColumn("date", F.to_date("timestamp")), f"{out_base}/{name}", batch_id, ["date"])
            for name in ("log", "unknown"):
                write_batch_once(routes[name].select(F.to_json(F.struct("*")).alias("message")), f"{out_base}/{name}",
                                 batch_id)
            write_batch_once(bad, f"{out_base}/rejects", batch_id)
        finally:
            parsed.unpersist()

    return (lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write_batch)
            .trigger(**trigger_options(available_now)).start())
