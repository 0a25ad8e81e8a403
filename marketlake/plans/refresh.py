"""A13 / A14 kept up to date: bars and profiles refreshed from new batches alone.

Source: a table with a folder per batch (``batch_id=N``, as the streams write).
Store: partial aggregates by (run, batch) and a log of which run holds a batch.
A refresh lists the source's files (names, sizes and times; nothing is read),
reads the batches that are new or whose files have changed since, writes
their partials under a new run and then appends the log. The result is the
merge of the partials that the log names, so a refresh that dies leaves
nothing behind that counts, and a batch that is run again replaces itself.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.rollup import Rollup

_LOG = "batch_id long, stamp string, run string, seq long"


def source_batches(spark: SparkSession, source: str) -> DataFrame:
    """(batch_id, stamp): what the batch's files are now."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(source)
             .select(F.col("batch_id").cast("long").alias("batch_id"), "path", "length", "modificationTime"))
    each = F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    return files.groupBy("batch_id").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"),
                                                     F.sum(F.xxhash64(each).cast("decimal(38,0)")).cast("string")).alias("stamp"))


def committed(spark: SparkSession, store: str) -> DataFrame:
    """(batch_id, stamp, run, seq) of the run that holds each batch."""
    try:
        log = spark.read.schema(_LOG).parquet(f"{store}/log")
    except AnalysisException:   # nothing was ever refreshed
        return spark.createDataFrame([], _LOG)
    last = F.row_number().over(Window.partitionBy("batch_id").orderBy(F.col("seq").desc()))
    return log.withColumn("_n", last).where("_n = 1").drop("_n")


def refresh(spark: SparkSession, source: str, store: str, rollup: Rollup) -> int:
    """Bring the store up to the source; returns the number of batches read."""
    done = committed(spark, store)
    new = (source_batches(spark, source).join(done.select("batch_id", F.col("stamp").alias("held")), "batch_id", "left")
           .where("held is null or held <> stamp").select("batch_id", "stamp"))
    new = new.persist()     # two uses of one small list, one row per new batch
    try:
        count = new.count()
        if not count:
            return 0
        run, seq = uuid.uuid4().hex, (done.agg(F.max("seq")).first()[0] or 0) + 1
        rows = spark.read.parquet(source).withColumn("batch_id", F.col("batch_id").cast("long"))
        if count <= 1000:       # as literals they prune folders when the scan is planned
            rows = rows.where(F.col("batch_id").isin([r.batch_id for r in new.select("batch_id").collect()]))
        else:
            rows = rows.join(new.select("batch_id"), "batch_id", "left_semi")
        keyed = rollup.keyed(rows).groupBy("batch_id", *rollup.keys).agg(*[c.alias(n) for n, c in rollup.rows.items()])
        keyed.write.parquet(f"{store}/partials/run={run}")
        log = new.select("batch_id", "stamp", F.lit(run).alias("run"), F.lit(seq).cast("long").alias("seq"))
        log.coalesce(1).write.mode("append").parquet(f"{store}/log")
        return count
    finally:
        new.unpersist()


def refreshed(spark: SparkSession, store: str, rollup: Rollup) -> DataFrame:
    """The result of all batches that the store holds."""
    held = committed(spark, store).select("run", "batch_id")
    partials = spark.read.option("basePath", f"{store}/partials").parquet(f"{store}/partials")
    return rollup.final(partials.join(held, ["run", "batch_id"], "left_semi"))
