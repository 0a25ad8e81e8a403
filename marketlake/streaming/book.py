"""T5: the current order book as keyed map state.

One state map per symbol holds a value per (side, level), one small value the
newest update and the oldest level. A micro-batch writes only the levels it
changes: the RocksDB store with changelog checkpoints uploads the difference,
not the book. Before rows reach the state, each input partition keeps the
newest row per level (a map-side combine), so a symbol that sends a third of
all rows hands its state at most levels x partitions of them.

Two rules delete levels (the time-to-live of a depth message): an update of a
symbol deletes its levels older than the update minus the time to live, and
an event-time timer deletes what the watermark has outlived, so the book of a
symbol that falls silent empties without a new row. The output is a change
log (update mode); ``current_book`` resolves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.timefn import interval_micros
from .jobs import to_event_time, to_table_time

#: ``removed`` marks a level that is no longer in the book; its other values are those it last had.
BOOK_CHANGES = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("side", T.StringType()),
    T.StructField("level", T.IntegerType()), T.StructField("price", T.StringType()),
    T.StructField("size", T.IntegerType()), T.StructField("order_count", T.IntegerType()),
    T.StructField("us", T.LongType()), T.StructField("id", T.LongType()), T.StructField("removed", T.BooleanType()),
])
_LEVEL = "side string, level int"
_VALUE = "price string, size int, order_count int, us long, id long"
_SPAN = "newest long, oldest long"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state on local disk with changelog checkpoints (the state of ``transformWithState`` needs this store)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def newest_per_level(rows: DataFrame) -> DataFrame:
    """Of each Arrow batch the newest row per (symbol, side, level): nothing older can change a book.

    Rows without a level only move the watermark; a filter would be pushed below it, so they are left out here."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in batches:
            chunk = chunk.dropna(subset=["side", "level", "us"])
            yield chunk.sort_values(["us", "id"]).drop_duplicates(["symbol", "side", "level"], keep="last")
    return rows.mapInPandas(run, rows.schema)


def _int(value) -> int | None:
    return None if pd.isna(value) else int(value)


class BookProcessor(StatefulProcessor):
    """Levels of one symbol."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", _LEVEL, _VALUE)
        self.span = handle.getValueState("span", _SPAN)

    def _expire(self, symbol: str, newest: int, before: int) -> list[tuple]:
        """Remove levels older than ``before``; note the oldest that is left and set the timer for it."""
        gone, oldest = [], None
        for level, value in list(self.levels.iterator()):
            if value[3] < before:
                self.levels.removeKey(level)
                gone.append((symbol, *level, *value, True))
            else:
                oldest = value[3] if oldest is None else min(oldest, value[3])
        if oldest is None:
            self.span.clear()
        else:
            self.span.update((newest, oldest))
            self._wake(oldest)
        return gone

    def _wake(self, oldest: int) -> None:
        self.handle.registerTimer((oldest + self.ttl_us) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        symbol, changed = key[0], {}
        newest, oldest = self.span.get() if self.span.exists() else (None, None)
        had = oldest
        for chunk in rows:
            for r in chunk.sort_values(["us", "id"]).drop_duplicates(["side", "level"], keep="last").itertuples(index=False):
                level = (r.side, int(r.level))
                now = self.levels.getValue(level) if self.levels.containsKey(level) else None
                if now is not None and (now[3], now[4]) >= (int(r.us), int(r.id)):
                    continue
                value = (r.price, _int(r.size), _int(r.order_count), int(r.us), int(r.id))
                self.levels.updateValue(level, value)
                changed[level] = value
                newest = value[3] if newest is None else max(newest, value[3])
                oldest = value[3] if oldest is None else min(oldest, value[3])
        if changed:
            gone = []
            if oldest < newest - self.ttl_us:
                gone = self._expire(symbol, newest, newest - self.ttl_us)
            else:
                self.span.update((newest, oldest))
                if had is None:
                    self._wake(oldest)
            lost = {(g[1], g[2]) for g in gone}
            out = [(symbol, *level, *value, False) for level, value in changed.items() if level not in lost]
            yield pd.DataFrame(out + gone, columns=BOOK_CHANGES.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.span.exists():
            return
        newest, _ = self.span.get()
        # an update of a level leaves the timer of its former time behind: what counts is the time it has now
        gone = self._expire(key[0], newest, timerValues.getCurrentWatermarkInMs() * 1000 - self.ttl_us)
        if gone:
            yield pd.DataFrame(gone, columns=BOOK_CHANGES.names)

    def close(self) -> None:
        pass


def book_changes(depth: DataFrame, ttl: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """T5: change log of the current book per symbol, one row per level set or removed."""
    use_rocksdb(depth.sparkSession)
    rows = to_event_time(depth).withWatermark("timestamp", watermark).select(
        "symbol", "side", "level", F.col("price").cast("string").alias("price"), "size", "order_count", "timestamp", "id",
        F.unix_micros("timestamp").alias("us"))
    out = newest_per_level(rows).groupBy("symbol").transformWithStateInPandas(
        BookProcessor(interval_micros(ttl)), BOOK_CHANGES, "Update", "EventTime")
    out = (out.withColumn("price", F.col("price").cast("decimal(20,8)"))
           .withColumn("timestamp", F.timestamp_micros("us")).drop("us"))
    return to_table_time(out, ["timestamp"])


def current_book(changes: DataFrame, version: str = "batch_id") -> DataFrame:
    """The book that a stored change log leads to: the newest change of each level, if it was not removed.

    Within a micro-batch a removal of a level follows its update (timers fire after rows)."""
    keys = ["symbol", "side", "level"]
    last = F.max_by(F.struct("price", "size", "order_count", "timestamp", "id", "removed"), F.struct(version, "removed"))
    return (changes.groupBy(*keys).agg(last.alias("last")).select(*keys, "last.*").where("not removed").drop("removed"))
