"""The range-partitioned (skew-safe) helpers equal plain whole-key windows and brute force."""

import datetime as dt
import random

import pandas as pd
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from marketlake.functions.sequence import last_non_null, previous_row, running_sum
from marketlake.operators import flow, quality


def _frame(spark, n, seed, hot=0.6):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        sym = "HOT" if rnd.random() < hot else rnd.choice(["A", "B", "C"])
        ts = base + dt.timedelta(seconds=rnd.randrange(0, 5 * 86400))
        val = rnd.choice([None, rnd.randrange(-50, 50)])
        rows.append((i, sym, ts, val))
    return spark.createDataFrame(rows, "id long, symbol string, timestamp timestamp_ntz, v int")


@settings(max_examples=4, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_helpers_match_plain_windows(spark, seed):
    df = _frame(spark, 400, seed)
    w = Window.partitionBy("symbol").orderBy("timestamp", "id")
    want = df.select("id", F.lag("timestamp").over(w).alias("p"),
                     F.sum(F.coalesce("v", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
                     F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("f"))
    got = previous_row(df, ["symbol"], ["timestamp", "id"], ["timestamp"])
    got = running_sum(got.withColumn("v0", F.coalesce("v", F.lit(0))), ["symbol"], ["timestamp", "id"], "v0", "s")
    got = last_non_null(got, ["symbol"], ["timestamp", "id"], "v", "f")
    got = got.select("id", F.col("prev_timestamp").alias("p"), "s", "f")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_asof_matches_pandas(spark):
    df = _frame(spark, 600, 7)
    trades = df.filter("id % 3 != 0").select("id", "symbol", "timestamp", F.col("v").alias("size"))
    quotes = df.filter("id % 3 = 0").select("id", "symbol", "timestamp",
                                            F.col("v").cast("decimal(20,8)").alias("bid_price"),
                                            F.col("v").cast("decimal(20,8)").alias("ask_price"),
                                            F.col("v").alias("bid_size"), F.col("v").alias("ask_size"))
    got = flow.asof_quotes(trades, quotes).select("id", "quote_timestamp").toPandas().sort_values("id")
    t = trades.toPandas().sort_values("timestamp")
    q = quotes.toPandas().rename(columns={"timestamp": "quote_timestamp"})[["symbol", "quote_timestamp"]]
    q = q.sort_values("quote_timestamp")
    m = pd.merge_asof(t, q, left_on="timestamp", right_on="quote_timestamp", by="symbol",
                      direction="backward").sort_values("id")
    assert list(got["quote_timestamp"].astype("string").fillna("")) == \
        list(m["quote_timestamp"].astype("string").fillna(""))


def _greedy(times, c):
    fired, last = [], None
    for t in sorted(set(times)):
        if last is None or (t - last).total_seconds() >= c:
            fired.append(t)
            last = t
    return fired


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=20_000), min_size=1, max_size=60))
def test_suppress_equals_greedy(spark, offsets):
    base = dt.datetime(2024, 1, 1, 23, 0)
    times = [base + dt.timedelta(seconds=o) for o in offsets]
    df = spark.createDataFrame([("e", "t", t) for t in times], "entity string, alert_type string, ts timestamp_ntz")
    got = sorted(set(r.ts for r in quality.suppress(df, "300 seconds").collect()))
    assert got == _greedy(times, 300)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=4_000), min_size=1, max_size=40))
def test_suppress_path_walk_equals_greedy(spark, offsets):
    """Dense alerts: long chains."""
    base = dt.datetime(2024, 1, 1, 23, 0)
    times = [base + dt.timedelta(seconds=o) for o in offsets]
    df = spark.createDataFrame([("e", "t", t) for t in times], "entity string, alert_type string, ts timestamp_ntz")
    got = sorted(set(r.ts for r in quality.suppress(df, "300 seconds").collect()))
    assert got == _greedy(times, 300)


def test_hot_symbol_and_day_are_split(spark):
    """90% of the rows in one symbol and one day: no range partition holds much more than its share."""
    base = dt.datetime(2024, 1, 1)
    df = spark.range(40_000).select(
        F.col("id"), F.when(F.col("id") % 10 < 9, "HOT").otherwise(F.concat(F.lit("S"), F.col("id") % 7)).alias("symbol"),
        F.timestamp_add("SECOND", F.when(F.col("id") % 10 < 9, F.col("id") % 80_000).otherwise(F.col("id") * 60),
                        F.lit(base)).alias("timestamp"))
    from marketlake.functions.sequence import PART, ranged
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sorted(r["count"] for r in ranged(df, ["symbol"], ["timestamp", "id"]).groupBy(PART).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 2 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_upsert_numbers_many_new_symbols(spark):
    """Ids are consecutive and no symbol is lost, with partitions coalesced or not."""
    from marketlake.operators import joins
    now = dt.datetime(2024, 5, 1)
    current = spark.createDataFrame([(i, f"OLD{i}", "CME", None, True, now, now) for i in range(1, 7)],
                                    "id bigint, symbol string, exchange string, description string, active boolean, "
                                    "created_at timestamp_ntz, updated_at timestamp_ntz")
    new = spark.range(100_000).select(F.concat(F.lit("n"), F.hex(F.xxhash64("id"))).alias("symbol"),
                                      F.lit("CME").alias("exchange"))
    for coalesce in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        got = joins.upsert_symbols(current, new, now).agg(
            F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max("id").alias("top")).first()
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert (got["n"], got["ids"], got["top"]) == (100_006, 100_006, 100_006)
