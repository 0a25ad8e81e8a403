"""Gaps and stalls per symbol, from panes.

Ticks are first reduced to the first and last time per symbol and pane, an
eighth of the threshold long: no gap fits into a pane, so nothing else of it
matters, and the keyed state meets one row per pane however many ticks a symbol
sends. A pane is settled when the watermark has passed it, so a row that is
late by up to the watermark's delay never leaves a gap that is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.timefn import interval_micros
from .book import use_rocksdb
from .jobs import to_event_time

PANES = 8
_OUT = "symbol string, kind string, start_us long, end_us long"
_COLUMNS = ["symbol", "kind", "start_us", "end_us"]


class GapProcessor(StatefulProcessor):
    """The last settled time of one symbol; a timer for its silence."""

    def __init__(self, threshold_us: int, pane_us: int):
        self.threshold_us, self.pane_us = threshold_us, pane_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, stalled boolean")

    def _silent_at(self, last: int) -> int:
        """From this watermark on a tick within the threshold would be in a pane that is settled."""
        return last + self.threshold_us + self.pane_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:      # a heartbeat: it has moved the watermark
            return
        panes = pd.concat([chunk[["first_us", "last_us"]] for chunk in rows]).sort_values("first_us").to_numpy()
        starts, last = panes[:, 0], self.last.get()[0] if self.last.exists() else None
        before = np.concatenate(([starts[0] if last is None else last], panes[:-1, 1]))
        out = [(key[0], "gap", int(before[i]), int(starts[i])) for i in np.flatnonzero(starts - before > self.threshold_us)]
        last = int(panes[-1, 1])
        if self._silent_at(last) <= timerValues.getCurrentWatermarkInMs() * 1000:
            out.append((key[0], "stall", last, None))
            self.last.update((last, True))
        else:
            self.last.update((last, False))
            self.handle.registerTimer(self._silent_at(last) // 1000 + 1)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a newer tick leaves the timer of the one before behind
        if self.last.exists():
            last, stalled = self.last.get()
            if not stalled and self._silent_at(last) <= timerValues.getCurrentWatermarkInMs() * 1000:
                self.last.update((last, True))
                yield pd.DataFrame([(key[0], "stall", last, None)], columns=_COLUMNS)

    def close(self) -> None:
        pass


def gap_stream(ticks: DataFrame, threshold: str = "300 seconds", watermark: str = "10 minutes") -> DataFrame:
    """Per symbol, consecutive ticks further apart than ``threshold`` (kind
    'gap') and symbols silent for ``threshold`` past their last tick as seen by
    the watermark (kind 'stall', known one pane later, from a timer). A symbol
    that comes back after a stall has its gap reported too. Times are
    epoch microseconds throughout, independent of the session's zone. Rows
    without a symbol only advance the watermark (heartbeats)."""
    use_rocksdb(ticks.sparkSession)
    threshold_us = interval_micros(threshold)
    pane_us = max(1, threshold_us // PANES)
    src = to_event_time(ticks).withWatermark("timestamp", watermark).select(
        "symbol", "timestamp", F.unix_micros("timestamp").alias("us"))
    panes = src.groupBy("symbol", F.window("timestamp", f"{pane_us} microseconds").alias("w")).agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us")).select(
        "symbol", F.window_time("w").alias("timestamp"), "first_us", "last_us")
    out = panes.groupBy("symbol").transformWithStateInPandas(GapProcessor(threshold_us, pane_us), _OUT, "Append", "EventTime")
    return out.select("symbol", "kind", F.timestamp_micros("start_us").cast("timestamp_ntz").alias("gap_start"),
                      F.timestamp_micros("end_us").cast("timestamp_ntz").alias("gap_end"),
                      F.round((F.col("end_us") - F.col("start_us")) / 1e6, 6).alias("gap_seconds"))
