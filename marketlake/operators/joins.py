"""Symbol joins: J1 listing, J2 directory, J4 upsert, J5 insert-if-absent,
J8 subscription filter.

Ticks are always aggregated *before* they meet the symbol dimension, so the
joins are between per-symbol summaries and a dimension. No side is hinted:
Spark broadcasts what it measures to be under its byte threshold.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numbering import consecutive_ids
from ..functions.timefn import resolve_as_of, ts_literal
from .stats import depth_activity, tick_activity


def symbol_listing(symbols: DataFrame, ticks: DataFrame) -> DataFrame:
    """Every symbol with its tick count (0 if none) and last tick."""
    per = ticks.groupBy("symbol").agg(F.count(F.lit(1)).alias("tick_count"),
                                      F.max("timestamp").alias("last_tick"))
    dim = symbols.select("symbol", "exchange", "active")
    return (dim.join(per, "symbol", "left")
               .select("symbol", "exchange", "active",
                       F.coalesce(F.col("tick_count"), F.lit(0).cast("bigint")).alias("tick_count"),
                       "last_tick"))


def symbol_directory(ticks: DataFrame, depth: DataFrame, as_of: dt.datetime | None = None,
                     interval: str = "24 hours") -> DataFrame:
    """24h tick activity full-outer-joined with 24h depth activity by
    symbol. A symbol seen on several exchanges is one row: counts summed,
    exchange of the newest update. Missing side: 'Unknown', 0, NULL."""
    anchor = resolve_as_of(ticks, as_of)
    ta = tick_activity(ticks, anchor, interval).groupBy("symbol").agg(
        F.max_by("exchange", F.struct("last_update", "exchange")).alias("exchange"),
        F.sum("tick_count").alias("tick_count"),
        F.max("last_update").alias("last_tick_update"))
    da = depth_activity(depth, anchor, interval).withColumnRenamed("last_update", "last_level2_update")
    j = ta.join(da, "symbol", "full")
    return j.select(
        "symbol",
        F.coalesce(F.col("exchange"), F.lit("Unknown")).alias("exchange"),
        F.coalesce(F.col("tick_count"), F.lit(0).cast("bigint")).alias("tick_count"),
        "last_tick_update",
        F.coalesce(F.col("level2_count"), F.lit(0).cast("bigint")).alias("level2_count"),
        "last_level2_update")


def upsert_symbols(current: DataFrame, incoming: DataFrame, as_of: dt.datetime,
                   default_exchange: str = "CME") -> DataFrame:
    """Insert new symbols; for an existing symbol set ``active`` and touch
    ``updated_at`` (exchange and description keep their stored values).
    New ids continue after the current maximum, in symbol order
    (``consecutive_ids``: distributed, no single-task window)."""
    now = ts_literal(as_of)
    inc = incoming.select(F.upper(F.trim("symbol")).alias("symbol"),
                          F.col("exchange").alias("in_exchange"),
                          (F.col("description") if "description" in incoming.columns
                           else F.lit(None).cast("string")).alias("in_description"))
    inc = inc.groupBy("symbol").agg(F.min("in_exchange").alias("in_exchange"),
                                    F.min("in_description").alias("in_description"),
                                    F.lit(True).alias("_hit"))
    cur = current.alias("c")
    j = cur.join(inc.alias("i"), "symbol", "full")
    max_id = current.agg(F.max("id").alias("m")).first()["m"] or 0
    is_new = F.col("c.id").isNull()
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    merged = j.select(
        F.col("c.id").alias("id"), "symbol",
        F.coalesce(F.col("c.exchange"), F.col("in_exchange"), F.lit(default_exchange)).alias("exchange"),
        F.coalesce(F.col("c.description"), F.col("in_description")).alias("description"),
        F.when(hit, F.lit(True)).otherwise(F.col("c.active")).alias("active"),
        F.when(is_new, now).otherwise(F.col("c.created_at")).alias("created_at"),
        F.when(hit, now).otherwise(F.col("c.updated_at")).alias("updated_at"),
        is_new.alias("_new"))
    old = merged.filter(~F.col("_new"))
    new = consecutive_ids(merged.filter(F.col("_new")).drop("id"), ["symbol"], "id", int(max_id))
    return old.unionByName(new.select(*old.columns)).drop("_new")


def insert_missing(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ON CONFLICT (keys) DO NOTHING - incoming rows whose keys are absent
    (and not repeated within the batch) are appended."""
    keys = list(keys)
    fresh = incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")
    return current.unionByName(fresh.select(*current.columns))


def subscribed_only(stream: DataFrame, subscriptions: DataFrame,
                    keys: Sequence[str] = ("symbol", "exchange")) -> DataFrame:
    """Keep rows of subscribed (symbol, exchange); a repeated request is
    a no-op (distinct). Semi join, broadcast only if Spark measures it small."""
    subs = subscriptions.select(*keys).dropDuplicates(list(keys))
    return stream.join(subs, list(keys), "left_semi")
