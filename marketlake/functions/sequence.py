"""Order-dependent per-key computations that survive a hot key.

A window over ``partitionBy(symbol)`` sends every row of a symbol to one task;
if one symbol holds a third of the data, that task holds a third of the job.
These helpers range-partition the rows by (keys, order) - a hot key, or a hot
key's day, is spread over as many partitions as its rows need - and window
inside (partition, key). What crosses a partition border (the previous row, a
running total, the last non-null value) comes from a summary of one row per
(partition, key): every key but those that span partitions has a single row
there, so its size is the number of keys plus the number of partitions.

The ranged rows are checkpointed once (``spark.checkpoint.dir``): the input is
scanned once, and rows and summary come from the same partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint_dir

PART = "_seq_part"


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` range-partitioned by keys and order, stored once, with its partition number."""
    checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()).checkpoint()


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 carry: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>`` = value of ``c`` in the preceding row of the same key.

    Equivalent to ``lag(c).over(partitionBy(keys).orderBy(order))``.
    """
    keys, order, carry = list(keys), list(order), list(carry)
    rows = ranged(df, keys, order)
    w = Window.partitionBy(PART, *keys).orderBy(*_cols(order))
    b = rows.withColumn("_seq_rn", F.row_number().over(w))
    for c in carry:
        b = b.withColumn(f"_seq_lag_{c}", F.lag(c).over(w))
    # Last row of each (partition, key), then that of the key's previous partition.
    last = rows.groupBy(PART, *keys).agg(F.max_by(F.struct(*carry), F.struct(*order)).alias("_seq_last"))
    edge = last.select(PART, *keys, F.lag("_seq_last").over(Window.partitionBy(*keys).orderBy(PART)).alias("_seq_edge"))
    out = b.join(edge, [PART, *keys], "left")
    for c in carry:
        out = out.withColumn(f"{prefix}{c}", F.when(F.col("_seq_rn") == 1, F.col(f"_seq_edge.{c}"))
                             .otherwise(F.col(f"_seq_lag_{c}")))
    return out.drop("_seq_rn", "_seq_edge", PART, *[f"_seq_lag_{c}" for c in carry])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``out`` = cumulative sum of ``value`` per key in ``order`` (inclusive).

    Two-level prefix sum: totals per (partition, key), a prefix over those
    small totals gives each partition's offset, and a running sum inside.
    """
    keys, order = list(keys), list(order)
    rows = ranged(df, keys, order)
    w = (Window.partitionBy(PART, *keys).orderBy(*_cols(order))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = rows.groupBy(PART, *keys).agg(F.sum(value).alias("_seq_tot"))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(PART, *keys, F.coalesce(F.sum("_seq_tot").over(before), F.lit(0)).alias("_seq_off"))
    res = rows.withColumn("_seq_in", F.sum(value).over(w)).join(offsets, [PART, *keys], "left")
    return (res.withColumn(out, F.col("_seq_in") + F.coalesce(F.col("_seq_off"), F.lit(0)))
            .drop("_seq_in", "_seq_off", PART))


def last_non_null(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                  out: str, descending: bool = False) -> DataFrame:
    """Add ``out`` = last non-null ``value`` at or before each row, per key (forward fill).

    The fill that crosses partition borders comes from the newest non-null
    value of the nearest earlier partition that has one. With
    ``descending=True`` the sequence runs backwards: each row gets the first
    non-null value at or after it (a backward fill).
    """
    keys, order = list(keys), list(order)
    rows = ranged(df, keys, order)
    cols = [c.desc() for c in _cols(order)] if descending else _cols(order)
    w = Window.partitionBy(PART, *keys).orderBy(*cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordering = F.when(F.col(value).isNotNull(), F.struct(*order))
    pick = F.min_by if descending else F.max_by
    last = rows.groupBy(PART, *keys).agg(pick(F.col(value), ordering).alias("_seq_blast"))
    before = (Window.partitionBy(*keys).orderBy(F.col(PART).desc() if descending else F.col(PART))
              .rowsBetween(Window.unboundedPreceding, -1))
    edge = last.select(PART, *keys, F.last("_seq_blast", ignorenulls=True).over(before).alias("_seq_edge"))
    res = rows.withColumn("_seq_fill", F.last(value, ignorenulls=True).over(w)).join(edge, [PART, *keys], "left")
    return (res.withColumn(out, F.coalesce(F.col("_seq_fill"), F.col("_seq_edge")))
            .drop("_seq_fill", "_seq_edge", PART))
