"""Consecutive ids in a sort order without a single-task window.

``row_number().over(Window.orderBy(...))`` moves every row to one task. Here
rows are range-partitioned on the order key, each partition counts its rows
(one small row per partition), a prefix sum over those counts gives every
partition its offset, and rows are numbered inside their partition. Only the
per-partition counts meet in one place, and that table is broadcast with a
bound proven by construction (one row per shuffle partition). The ranged rows
are checkpointed once, so counts and numbers come from the same partitions
whatever a second planning of the shuffle would have chosen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import checkpoint_dir


def consecutive_ids(df: DataFrame, order: list[str], out: str, start: int = 0) -> DataFrame:
    """Add ``out`` = start + 1, start + 2, ... following ``order`` (ties by all columns given)."""
    checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).withColumn("_num_pid", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("_num_pid").agg(F.count(F.lit(1)).alias("_num_n"))
    before = Window.orderBy("_num_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_num_pid", F.coalesce(F.sum("_num_n").over(before), F.lit(0)).alias("_num_off"))
    local = F.row_number().over(Window.partitionBy("_num_pid").orderBy(*order))
    return (ranged.withColumn("_num_rn", local)
                  .join(F.broadcast(offsets), "_num_pid")
                  .withColumn(out, (F.lit(start) + F.col("_num_off") + F.col("_num_rn")).cast("bigint"))
                  .drop("_num_pid", "_num_rn", "_num_off"))
