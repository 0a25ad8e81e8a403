"""Event tables stored by day, and what their layout and file statistics answer without a scan.

Layout: ``<path>/date=YYYY-MM-DD/...parquet``, range-clustered by (symbol,
time) within a day, with the event time also as microseconds (``ts_us``: file
statistics of a BIGINT are exact and usable, those of a timestamp are not) and
Bloom filters on the key column.

- O1-O3: the newest N rows come from the newest days; days are looked at
  newest first until N rows are there, since no older day holds a newer row.
- A1, A3, A4, A12: counts and time ranges are pushed into the Parquet footers
  (``PushedAggregation``); only the day that a cut-off falls into is scanned.
- T9, J5, E6: whether a key is already stored is asked of the days the batch
  has rows for, and of the row groups whose Bloom filter admits one of its keys.
"""

from __future__ import annotations

import contextlib
import datetime as dt
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.timefn import parse_interval, ts_literal
from ..operators.topk import newest

#: Keys and days of a batch that are looked up by literal; a larger batch is joined.
LOOKUP_KEYS, LOOKUP_DAYS = 2_000, 400
TS_US = "ts_us"
#: Longest list that the Parquet reader checks value by value (Spark's default).
PUSHED_IN = 10


# ------------------------------------------------------------------ layout

def write_day_table(df: DataFrame, path: str, ts_col: str = "timestamp", key: str | None = None,
                    mode: str = "append", expected_keys: int = 1_000_000, partition_by: Sequence[str] = ()) -> None:
    """Append (or overwrite) rows of any days; ``key`` gets a Bloom filter per row group."""
    cluster = [c for c in ("symbol", ts_col) if c in df.columns]
    out = df.withColumn("date", F.to_date(F.col(ts_col))).withColumn(TS_US, _micros(F.col(ts_col)))
    writer = (out.repartitionByRange("date", *cluster).sortWithinPartitions("date", *cluster)
              .write.mode(mode).partitionBy("date", *partition_by))
    if key:
        writer = (writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
                  .option(f"parquet.bloom.filter.expected.ndv#{key}", str(expected_keys)))
    writer.parquet(path)


def _micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less time, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _time(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def read_day_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(TS_US)


def days_of(spark: SparkSession, path: str) -> list[dt.date]:
    """Stored days, newest first: names of folders, no file is opened."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(where) if f.isDirectory()] if store.exists(where) else []
    return sorted((dt.date.fromisoformat(n.split("=", 1)[1]) for n in names if n.startswith("date=2") or n.startswith("date=1")),
                  reverse=True)


# ------------------------------------------------------------------ O1-O3: the newest N rows

def newest_rows(spark: SparkSession, path: str, n: int, where: Column | None = None, ts_col: str = "timestamp",
                tie: str = "id") -> tuple[DataFrame, list[dt.date]]:
    """(the newest ``n`` rows, days read). Days are counted newest first in steps that double, until ``n`` rows are
    there; rows of one time share a day, so ties at the border are all seen."""
    days, taken, have, step = days_of(spark, path), 0, 0, 1
    table = read_day_table(spark, path)
    while taken < len(days) and have < n:
        some = days[taken:taken + step]
        rows = table.where(F.col("date").between(F.lit(some[-1]), F.lit(some[0])))
        rows = rows if where is None else rows.where(where)
        have += rows.limit(n).count()       # no more than n rows are counted, however many the days hold
        taken, step = taken + step, step * 2
    read = days[:taken]
    if not read:
        return newest(table.where(F.lit(False)), n, ts_col, tie).drop("date"), []
    rows = table.where(F.col("date") >= F.lit(read[-1]))
    return newest(rows if where is None else rows.where(where), n, ts_col, tie).drop("date"), read


def latest_time(spark: SparkSession, path: str, ts_col: str = "timestamp") -> dt.datetime | None:
    """The ``as_of`` anchor: newest time of the newest day that has rows."""
    top, _ = newest_rows(spark, path, 1, F.col(ts_col).isNotNull(), ts_col, ts_col)
    row = top.first()
    return None if row is None else row[ts_col]


# ------------------------------------------------------------------ A1, A3, A4, A12: file statistics

@contextlib.contextmanager
def _footer_reader(spark: SparkSession) -> Iterator[None]:
    """Tables loaded inside use the reader that answers count, min and max from Parquet footers."""
    name, before = "spark.sql.sources.useV1SourceList", spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    spark.conf.set(name, ",".join(s for s in before.split(",") if s != "parquet"))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def footer_table(spark: SparkSession, path: str) -> DataFrame:
    with _footer_reader(spark):
        return spark.read.parquet(path)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stored_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """A1: (table_name, row_count) from footers."""
    return _union([footer_table(spark, p).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
                   for n, p in paths.items()])


def stored_range(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """A3 without the distinct count: (table_name, total_rows, earliest, latest) from footers."""
    parts = []
    for name, path in paths.items():
        got = footer_table(spark, path).agg(F.count(F.lit(1)).alias("total_rows"), F.min(TS_US).alias("low"), F.max(TS_US).alias("high"))
        parts.append(got.select(F.lit(name).alias("table_name"), "total_rows", _time(F.col("low")).alias("earliest"),
                                _time(F.col("high")).alias("latest")))
    return _union(parts)


def stored_recent(spark: SparkSession, paths: Mapping[str, str], as_of: dt.datetime, interval: str = "1 hour") -> DataFrame:
    """A4: rows newer than ``as_of - interval``: whole days from footers, the cut-off's day by a scan of one column."""
    cutoff = as_of - parse_interval(interval)
    parts = []
    for name, path in paths.items():
        table = footer_table(spark, path)
        day = F.lit(cutoff.date())
        whole = table.where(F.col("date") > day).agg(F.count(F.lit(1)).alias("n"))
        part = table.where(F.col("date") == day).where(F.col(TS_US) > _micros_of(cutoff)).agg(F.count(F.lit(1)).alias("n"))
        parts.append(whole.unionByName(part).agg(F.sum("n").alias("recent_rows")).select(F.lit(name).alias("table_name"), "recent_rows"))
    return _union(parts)


def _micros_of(at: dt.datetime) -> int:
    return (at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def stored_freshness(spark: SparkSession, paths: Mapping[str, str], as_of: dt.datetime, interval: str = "5 minutes") -> DataFrame:
    """Whether the newest stored time is within ``interval`` of ``as_of``; from footers."""
    cutoff = _micros_of(as_of - parse_interval(interval))
    return _union([footer_table(spark, p).agg(F.max(TS_US).alias("high")).select(
        F.lit(n).alias("table_name"), F.coalesce(F.col("high") > cutoff, F.lit(False)).alias("healthy")) for n, p in paths.items()])


# ------------------------------------------------------------------ T9, J5, E6: keys that are already stored

def stored_rows_of(spark: SparkSession, path: str, batch: DataFrame, key: str, ts_col: str = "timestamp",
                   lookup_keys: int = LOOKUP_KEYS, lookup_days: int = LOOKUP_DAYS) -> DataFrame:
    """Stored rows that may hold a key of ``batch`` on one of its days: a superset of the stored rows with such keys.

    Up to ``lookup_keys`` keys become literals, which prune row groups by Bloom filter; a larger batch reads its days
    whole. Both are exact once joined on the key."""
    table = spark.read.parquet(path)
    days = [r.date for r in batch.select(F.to_date(ts_col).alias("date")).where("date is not null").distinct()
            .limit(lookup_days + 1).collect()]
    if len(days) > lookup_days:
        low, high = batch.agg(F.min(F.to_date(ts_col)), F.max(F.to_date(ts_col))).first()
        table = table.where(F.col("date").between(F.lit(low), F.lit(high)))
    else:
        table = table.where(F.col("date").isin(days))
    keys = [r[0] for r in batch.select(key).where(F.col(key).isNotNull()).distinct().limit(lookup_keys + 1).collect()]
    if keys and len(keys) <= lookup_keys:
        table = table.where(_one_of(F.col(key), keys))
    return table if keys else table.limit(0)


def _one_of(column: Column, values: list) -> Column:
    """``column`` in ``values``, as a balanced tree of short lists: those reach the file reader (which turns a long list
    into a range), and the tree stays shallow."""
    tests = [column.isin(values[i:i + PUSHED_IN]) for i in range(0, len(values), PUSHED_IN)]
    while len(tests) > 1:
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return tests[0]


def insert_new(spark: SparkSession, path: str, batch: DataFrame, batch_id: int, key: str = "id", ts_col: str = "timestamp") -> None:
    """Append the rows of ``batch`` whose (day, key) is not stored, each once; rows without key or time never conflict.

    Rows go to ``date=.../batch_id=...``, which a batch that is run again replaces, so it compares with the other batches
    alone. A key is compared within its day: the time of an event is part of its identity, and a replay repeats it."""
    batch = batch.withColumn("date", F.to_date(ts_col))
    fresh = batch.where(F.col(key).isNotNull() & F.col("date").isNotNull()).dropDuplicates(["date", key])
    loose = batch.where(F.col(key).isNull() | F.col("date").isNull())
    if days_of(spark, path):
        known = (stored_rows_of(spark, path, batch, key, ts_col).where(F.col("batch_id") != batch_id)
                 .select("date", key).distinct())
        fresh = fresh.join(known, ["date", key], "left_anti")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        out = fresh.select(*batch.columns).unionByName(loose).drop("date").withColumn("batch_id", F.lit(batch_id).cast("long"))
        write_day_table(out, path, ts_col, key, "overwrite", partition_by=["batch_id"])
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
