"""Day tables, file statistics, replay protection and refreshed results."""

import datetime as dt
import os
import random
import shutil
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketlake.operators import flow, rollup, stats
from marketlake.operators.topk import newest
from marketlake.plans import refresh
from marketlake.sources import daytables as days
from marketlake.streaming import jobs

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "id long, symbol string, timestamp timestamp_ntz, price decimal(20,8), size int, aggressor_side string"


def some(seed, count, span_days=20):
    rng = random.Random(seed)
    return [(i, rng.choice("ABC"), BASE + dt.timedelta(seconds=rng.randint(0, span_days * 86400 - 1)), Decimal(rng.randint(100, 140)) / 4,
             rng.randint(1, 9), rng.choice(("BUY", "SELL", None))) for i in range(count)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def scan_metrics(df) -> dict:
    """Rows that the scans of a collected plan handed out, and the files they opened."""
    df.collect()
    found = {"numOutputRows": 0, "numFiles": 0}
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if "Scan" in name:
                for key in found:
                    if node.metrics().contains(key):
                        found[key] += node.metrics().get(key).get().value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame(some(1, 3000), SCHEMA)
    path = str(tmp_path / "t")
    days.write_day_table(rows, path, key="id")
    return path, rows


def test_newest_rows_read_the_newest_days_alone(spark, table):
    path, rows = table
    for n, where, most in ((50, None, 1), (400, F.col("symbol") == "A", 15), (5000, None, 20), (3, F.col("symbol") == "Z", 20)):
        got, read = days.newest_rows(spark, path, n, where)
        want = newest(rows if where is None else rows.where(where), n)
        assert rows_of(got.select(*rows.columns)) == rows_of(want) and len(read) <= most
        assert read == sorted(read, reverse=True)
    assert days.latest_time(spark, path) == rows.agg(F.max("timestamp")).first()[0]
    shutil.rmtree(f"{path}/date=2024-01-03")      # an old day is not touched by a query for few rows
    got, read = days.newest_rows(spark, path, 50)
    assert got.count() == 50 and len(read) == 1 and scan_metrics(got)["numFiles"] == len(
        [f for f in os.listdir(f"{path}/date={read[0]}") if f.endswith(".parquet")])


def test_ties_at_the_border_of_days_and_of_n(spark, tmp_path):
    at = BASE + dt.timedelta(days=3)
    rows = spark.createDataFrame([(i, "A", at if i < 20 else at - dt.timedelta(microseconds=1), Decimal(1), 1, None) for i in range(40)], SCHEMA)
    days.write_day_table(rows, str(tmp_path / "t"))
    for n in (1, 19, 20, 21, 39, 40, 41):
        got, read = days.newest_rows(spark, str(tmp_path / "t"), n)
        assert [r.id for r in got.collect()] == [r.id for r in newest(rows, n).collect()]
        assert len(read) == (1 if n <= 20 else 2)
    empty, read = days.newest_rows(spark, str(tmp_path / "t"), 5, F.lit(False))
    assert empty.count() == 0 and len(read) == 2


def test_statistics_come_from_footers(spark, table):
    path, rows = table
    as_of = rows.agg(F.max("timestamp")).first()[0]
    paths = {"t": path}
    for got, want in (
            (days.stored_counts(spark, paths), stats.table_counts({"t": rows})),
            (days.stored_range(spark, paths), stats.table_stats(rows, "t").select("table_name", "total_rows", "earliest", "latest")),
            (days.stored_freshness(spark, paths, as_of), stats.freshness({"t": rows}, as_of))):
        plan = got._jdf.queryExecution().toString()
        assert "PushedAggregation: [COUNT" in plan or "PushedAggregation: [M" in plan
        assert rows_of(got) == rows_of(want)
        assert scan_metrics(got)["numOutputRows"] <= 40      # a row per file, not per tick
    for interval in ("30 hours", "1 hour", "7 days"):
        got = days.stored_recent(spark, paths, as_of, interval)
        assert rows_of(got) == rows_of(stats.recent_counts({"t": rows}, as_of, interval))
        assert got._jdf.queryExecution().toString().count("PushedAggregation: [COUNT(*)]") >= 1
    assert spark.conf.get("spark.sql.sources.useV1SourceList").count("parquet") == 1


def test_a_batch_replayed_weeks_later_adds_no_row_and_reads_few_row_groups(spark, tmp_path):
    path, rows = str(tmp_path / "t"), some(2, 4000)
    given = spark.createDataFrame(rows, SCHEMA)
    for n in range(4):
        days.insert_new(spark, path, given.where(F.col("id") % 4 == n), n)
    days.insert_new(spark, path, given.where("id % 4 = 1 and id < 400"), 4)
    days.insert_new(spark, path, given.where("id < 10").unionByName(given.where("id < 5")), 5)
    assert rows_of(days.read_day_table(spark, path).select(*given.columns)) == rows_of(given)
    # a batch that is run again replaces its rows
    days.insert_new(spark, path, given.where("id % 4 = 2"), 2)
    assert days.read_day_table(spark, path).count() == 4000
    # keys never seen, of days that are stored: Bloom filters leave no row group to decode
    strange = given.where("id < 50").withColumn("id", F.col("id") + 1_000_000)
    assert scan_metrics(days.stored_rows_of(spark, path, strange, "id").select("id"))["numOutputRows"] == 0
    some_keys = given.where("id in (8, 12)")
    assert 2 <= scan_metrics(days.stored_rows_of(spark, path, some_keys, "id").select("id"))["numOutputRows"] < 400
    many = given.where("id < 1900").withColumn("id", F.col("id") + 1_000_000)
    assert scan_metrics(days.stored_rows_of(spark, path, many, "id").select("id"))["numOutputRows"] < 2000
    # a batch above the bounds is joined instead, with the same result
    found = days.stored_rows_of(spark, path, given, "id", lookup_keys=10, lookup_days=3)
    assert found.join(given.select("id"), "id", "left_semi").count() == 4000


def test_rows_without_key_or_time_never_conflict(spark, tmp_path):
    rows = spark.createDataFrame([(None, "A", BASE, Decimal(1), 1, None), (1, "A", None, Decimal(1), 1, None)] * 2, SCHEMA)
    days.insert_new(spark, str(tmp_path / "t"), rows, 0)
    days.insert_new(spark, str(tmp_path / "t"), rows, 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 8


def test_a_refresh_reads_new_and_changed_batches_alone(spark, tmp_path):
    given = spark.createDataFrame(some(3, 600, 1), SCHEMA)
    what, source, store = rollup.bars("1 hour"), str(tmp_path / "src"), str(tmp_path / "store")
    for split in ([[0, 1, 2]], [[3], [4, 5], [6]]):
        for batches in split:
            for n in batches:
                jobs.write_batch_once(given.where(F.col("id") % 7 == n), source, n)
            assert refresh.refresh(spark, source, store, what) == len(batches)
            assert refresh.refresh(spark, source, store, what) == 0
    assert rows_of(refresh.refreshed(spark, store, what)) == rows_of(flow.build_bars(given, "1 hour"))
    # a batch is run again with the same rows, another with other rows; one loses all of its rows
    jobs.write_batch_once(given.where("id % 7 = 3"), source, 3)
    changed = given.where("id % 7 = 5").withColumn("price", (F.col("price") + 1).cast("decimal(20,8)"))
    jobs.write_batch_once(changed, source, 5)
    jobs.write_batch_once(given.where("false"), source, 6)
    assert refresh.refresh(spark, source, store, what) == 3
    want = given.where("id % 7 < 5").unionByName(changed.select(*given.columns))
    assert rows_of(refresh.refreshed(spark, store, what)) == rows_of(flow.build_bars(want, "1 hour"))
    # partials of a run that died before its log are no part of the result
    what.keyed(given.withColumn("batch_id", F.lit(0))).groupBy("batch_id", *what.keys).agg(
        *[c.alias(n) for n, c in what.rows.items()]).write.parquet(f"{store}/partials/run=dead")
    assert rows_of(refresh.refreshed(spark, store, what)) == rows_of(flow.build_bars(want, "1 hour"))
