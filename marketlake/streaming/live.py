"""Results that are visible while their window is open, and corrected when rows come late.

Every micro-batch is reduced to partial aggregates (``operators.rollup``) and
stored in a folder of its own, replaced if the batch runs again. A result is
the merge of the partials: nothing waits for a watermark, and no row is ever
too late. What the watermark decides is when a row *counts* as late: rows
whose period had closed when they came are also kept in a late table, and the
results that a batch closes or corrects are written as new versions.

``live_panes`` is the twin with Spark's state store: panes in update mode, each
version upserted under its batch number.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.timefn import interval_micros
from ..operators.rollup import Rollup, sliding
from .jobs import to_event_time, to_table_time, trigger_options, write_batch_once


def pane_length(window: str, slide: str) -> str:
    """The longest step that divides window and slide."""
    return f"{math.gcd(interval_micros(window), interval_micros(slide))} microseconds"


# ------------------------------------------------------------------ T4 / A8: update mode

def live_panes(stream: DataFrame, rollup: Rollup, out: str, checkpoint: str, watermark: str = "10 minutes",
               available_now: bool = True):
    """Panes of ``rollup`` in update mode: each micro-batch writes the panes it changed, as they now are. State is
    one row per pane that the watermark has not passed."""
    t = to_event_time(stream).withWatermark("timestamp", watermark)
    panes = t.groupBy("symbol", F.window("timestamp", rollup.period).alias("w")).agg(
        *[c.alias(n) for n, c in rollup.rows.items()])
    panes = panes.select("symbol", F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), *rollup.rows)
    times = [f.name for f in panes.schema.fields if f.dataType.typeName() == "timestamp"]

    def upsert(batch: DataFrame, batch_id: int) -> None:
        write_batch_once(to_table_time(batch, times), out, batch_id)
    return (panes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert)
            .trigger(**trigger_options(available_now)).start())


def newest_panes(spark: SparkSession, out: str, rollup: Rollup, upto: int | None = None) -> DataFrame:
    """The stored view: the newest version of every pane (as of batch ``upto``)."""
    log = spark.read.parquet(out)
    if upto is not None:
        log = log.where(F.col("batch_id") <= upto)
    values = [c for c in log.columns if c not in rollup.keys and c != "batch_id"]
    last = log.groupBy(*rollup.keys).agg(F.max_by(F.struct(*values), "batch_id").alias("last"))
    return last.select(*rollup.keys, "last.*")


def live_view(spark: SparkSession, out: str, rollup: Rollup, window: str, slide: str, upto: int | None = None) -> DataFrame:
    """The view's windows (open ones too), put together from panes after the aggregate."""
    return sliding(rollup, newest_panes(spark, out, rollup, upto), window, slide)


# ------------------------------------------------------------------ T6: partials by batch, late rows, versions

def rollup_with_corrections(stream: DataFrame, rollup: Rollup, out: str, checkpoint: str, watermark: str = "10 minutes",
                            available_now: bool = True):
    """``stream`` into four tables under ``out``, each with a folder per micro-batch:

    - ``partials``: the batch's partial aggregates;
    - ``progress``: the batch's newest time (the watermark of the next batch);
    - ``late``: rows whose period the watermark had passed when they came;
    - ``results``: versions of results that this batch closed, and of closed ones it corrected."""
    delay = interval_micros(watermark)
    spark = stream.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()     # read once for all tables; a lost block is recomputed from the source files
        try:
            write_batch_once(batch.agg(F.max("timestamp").alias("newest")), f"{out}/progress", batch_id)
            write_batch_once(rollup.partial(batch.where("symbol is not null")), f"{out}/partials", batch_id)
            before, now = (_mark(spark, out, b, delay) for b in (batch_id - 1, batch_id))
            late = rollup.keyed(batch).where(F.col("period_end") <= before).select(*batch.columns)
            write_batch_once(late, f"{out}/late", batch_id)
        finally:
            batch.unpersist()
        partials = spark.read.parquet(f"{out}/partials").where(F.col("batch_id") <= batch_id)
        touched = partials.where(F.col("batch_id") == batch_id).select(*rollup.keys).distinct()
        corrected = partials.join(touched.where(F.col("period_end") <= before), rollup.keys, "left_semi")
        closed = partials.where((F.col("period_end") > before) & (F.col("period_end") <= now))
        write_batch_once(rollup.merge(corrected.unionByName(closed)), f"{out}/results", batch_id)
    return (stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
            .trigger(**trigger_options(available_now)).start())


def _mark(spark: SparkSession, out: str, batch_id: int, delay_us: int):
    """The watermark after ``batch_id`` as a constant, one row per batch behind it; before any row it is far back."""
    newest = spark.read.parquet(f"{out}/progress").where(F.col("batch_id") <= batch_id).agg(F.max("newest")).first()[0]
    if newest is None:
        return F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.lit(-delay_us), F.lit(newest.isoformat(sep=" ")).cast("timestamp_ntz"))


def closed_results(spark: SparkSession, out: str, rollup: Rollup) -> DataFrame:
    """Closed results in their newest version."""
    log = spark.read.parquet(f"{out}/results")
    values = [c for c in log.columns if c not in rollup.keys and c != "batch_id"]
    last = log.groupBy(*rollup.keys).agg(F.max_by(F.struct(*values), "batch_id").alias("last"))
    return rollup.shown(last.select(*rollup.keys, "last.*"))


def open_results(spark: SparkSession, out: str, rollup: Rollup) -> DataFrame:
    """All results, closed or not, from the partials."""
    return rollup.final(spark.read.parquet(f"{out}/partials").drop("batch_id"))


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """Rows that came after their period had closed."""
    return spark.read.parquet(f"{out}/late").drop("batch_id")
