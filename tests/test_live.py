"""Live views, late corrections and mergeable partials."""

import datetime as dt
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketlake.operators import flow, rollup
from marketlake.streaming import jobs, live

BASE = dt.datetime(2024, 1, 1)
TICKS = ("id long, symbol string, timestamp timestamp_ntz, price decimal(20,8), size int, aggressor_side string, level int")


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def some_ticks(seed, count, span=600):
    rng = random.Random(seed)
    return [(i, rng.choice("AB"), at(rng.randint(0, span * 1000) / 1000), Decimal(rng.randint(100, 140)) / 4, rng.randint(1, 9),
             rng.choice(("BUY", "SELL", None)), rng.randint(1, 10)) for i in range(count)]


def put(spark, path, rows):
    spark.createDataFrame(rows, TICKS).coalesce(1).write.mode("append").parquet(str(path))


def stream(spark, path):
    return spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(str(path))


def rows_of(df, columns=None):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=repr)


def forget(ckpt, batch):
    for name in (f"{ckpt}/commits/{batch}", f"{ckpt}/commits/.{batch}.crc"):
        if os.path.exists(name):
            os.unlink(name)


def test_the_view_after_each_batch_equals_the_batch_query_over_what_has_arrived(spark, tmp_path):
    rows, pane = some_ticks(1, 240), rollup.activity(live.pane_length("60 seconds", "20 seconds"))
    parts = [rows[i:i + 80] for i in (0, 80, 160)]
    for part in parts:
        put(spark, tmp_path / "src", part)
    out = str(tmp_path / "out")
    jobs.run_to_completion(live.live_panes(stream(spark, tmp_path / "src"), pane, out, str(tmp_path / "c"), "1 hour"))
    for n in range(3):
        arrived = spark.createDataFrame(sum(parts[:n + 1], []), TICKS)
        w = F.window("timestamp", "60 seconds", "20 seconds")
        want = arrived.groupBy(w.alias("w"), "symbol").agg(
            F.count(F.lit(1)).alias("tick_count"), F.max("price").alias("max_price"), F.max("timestamp").alias("last_update")).select(
            "symbol", "w.start", "w.end", "tick_count", "max_price", "last_update")
        got = live.live_view(spark, out, pane, "60 seconds", "20 seconds", upto=n)
        assert rows_of(got, ["symbol", "period_start", "period_end", "tick_count", "max_price", "last_update"]) == rows_of(want)
    # only panes that a batch changed are written
    sizes = {r.batch_id: r["count"] for r in spark.read.parquet(out).groupBy("batch_id").count().collect()}
    assert sizes[1] <= 80 and sizes[2] <= 80


@pytest.mark.parametrize("distinct, error", [(10, 0.0), (20_000, 0.05)])
def test_sketched_levels_over_sliding_windows(spark, tmp_path, distinct, error):
    for n in range(2):
        spark.range(0, 40_000).select(
            "id", F.lit("A").alias("symbol"), F.timestamp_add("SECOND", (F.col("id") % 30).cast("int"), F.lit(BASE)).cast("timestamp_ntz").alias("timestamp"),
            F.lit(1).cast("decimal(20,8)").alias("price"), F.lit(1).alias("size"), F.lit("BUY").alias("aggressor_side"),
            F.pmod(F.hash("id") + n * 17, F.lit(distinct)).cast("int").alias("level")).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    pane, out = rollup.levels(live.pane_length("10 seconds", "2 seconds")), str(tmp_path / "out")
    jobs.run_to_completion(live.live_panes(stream(spark, tmp_path / "src"), pane, out, str(tmp_path / "c")))
    got = {(r.period_start): (r.updates, r.distinct_levels) for r in pane.shown(live.live_view(spark, out, pane, "10 seconds", "2 seconds")).collect()}
    exact = spark.read.parquet(str(tmp_path / "src")).groupBy(F.window("timestamp", "10 seconds", "2 seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("level").alias("d")).collect()
    assert len(got) == len(exact)
    for r in exact:
        updates, estimate = got[r.w.start]
        assert updates == r.n and abs(estimate - r.d) <= error * r.d


@pytest.mark.parametrize("what, batch", [(lambda: rollup.bars("1 minute"), lambda t: flow.build_bars(t, "1 minute")),
                                         (lambda: rollup.profile("1 minute", Decimal("0.5")), lambda t: flow.build_volume_profile(t, "1 minute", Decimal("0.5")))])
def test_late_rows_correct_closed_results_and_a_batch_run_again_changes_nothing(spark, tmp_path, what, batch):
    what = what()
    rows = some_ticks(3, 300, 1800) + [(900, "A", at(5), Decimal(1), 1, "BUY", 1), (901, "A", at(5), Decimal(2), 1, "BUY", 1)]
    random.Random(9).shuffle(rows)
    rows.append((1000, "B", at(4000), Decimal(9), 1, None, 1))
    rows += [(1001, "A", at(1), Decimal(3), 1, "SELL", 1)]     # behind everything, in a batch of its own
    parts = [rows[:100], rows[100:200], rows[200:-1], rows[-1:]]
    for part in parts:
        put(spark, tmp_path / "src", part)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "c")

    def run():
        jobs.run_to_completion(live.rollup_with_corrections(stream(spark, tmp_path / "src"), what, out, ckpt, "2 minutes"))
    run()
    given = spark.createDataFrame(rows, TICKS)
    closed = batch(given).where(F.col("timestamp") + F.expr("INTERVAL 1 MINUTE") <= F.lit(at(4000 - 120)).cast("timestamp_ntz"))
    assert rows_of(live.closed_results(spark, out, what)) == rows_of(closed)
    assert rows_of(live.open_results(spark, out, what)) == rows_of(batch(given))
    late, newest = set(), dt.datetime.min
    for part in parts:
        late |= {r[0] for r in part if r[2].replace(second=0, microsecond=0) + dt.timedelta(minutes=1) <= newest - dt.timedelta(minutes=2)} \
            if newest > dt.datetime.min else set()
        newest = max([newest] + [r[2] for r in part])
    assert {r.id for r in live.late_rows(spark, out).collect()} == late and 1001 in late
    forget(ckpt, 3)
    run()
    assert rows_of(live.closed_results(spark, out, what)) == rows_of(closed)
    assert {r.id for r in live.late_rows(spark, out).collect()} == late


def test_partials_of_any_split_merge_to_the_whole(spark):
    given = spark.createDataFrame(some_ticks(4, 500, 900), TICKS)
    for what, batch in ((rollup.bars("1 minute"), flow.build_bars(given, "1 minute")),
                        (rollup.profile("5 minutes"), flow.build_volume_profile(given, "5 minutes"))):
        for parts in (1, 7, 40):
            held = [what.partial(given.where(F.col("id") % parts == n)) for n in range(parts)]
            whole = held[0]
            for p in held[1:]:
                whole = whole.unionByName(p)
            assert rows_of(what.final(whole)) == rows_of(batch)
