"""Streams over several micro-batches: late rows, restarts, zones, new subscriptions."""

import datetime as dt
import os
import random
from decimal import Decimal

import pytest

from marketlake.streaming import book, gaps, jobs

BASE = dt.datetime(2024, 1, 1)


def put(spark, path, rows, schema="id long, symbol string, timestamp timestamp_ntz"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def ticks(spark, path):
    return spark.readStream.schema("id long, symbol string, timestamp timestamp_ntz").option(
        "maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_late_rows_leave_no_false_gap(spark, tmp_path, zone):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for rows in ([(1, "A", at(900)), (2, "A", at(1000))], [(3, "A", at(750))], [(4, "A", at(1001)), (5, "A", at(1500))],
                 [(6, None, at(100_000))]):
        put(spark, src, rows)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        q = jobs.write_batches(gaps.gap_stream(ticks(spark, src), "200 seconds", "10 minutes"), out, str(tmp_path / "c"))
        jobs.run_to_completion(q)
        got = sorted((r.kind, r.gap_start, r.gap_end, r.gap_seconds) for r in spark.read.parquet(out).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [("gap", at(1001), at(1500), 499.0), ("stall", at(1500), None, None)]


def test_a_batch_run_again_adds_nothing(spark, tmp_path):
    src, out, ckpt = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    os.makedirs(src)
    for i in range(3):
        with open(f"{src}/{i}.json", "w") as f:
            f.write('{"type": "TICK", "symbol": "A", "price": %d}\n{"type": "NOPE"}\nbroken\n' % i)
    jobs.run_to_completion(jobs.ingest_feed(spark, src, out, ckpt))
    first = spark.read.parquet(f"{out}/ticks").collect()
    assert len(first) == 3 and all(r.timestamp is not None and r.date is not None for r in first)
    last = max((f for f in os.listdir(f"{ckpt}/commits") if f.isdigit()), key=int)
    os.unlink(f"{ckpt}/commits/{last}")
    if os.path.exists(f"{ckpt}/commits/.{last}.crc"):
        os.unlink(f"{ckpt}/commits/.{last}.crc")
    jobs.run_to_completion(jobs.ingest_feed(spark, src, out, ckpt))
    for table in ("ticks", "unknown", "rejects"):
        assert spark.read.parquet(f"{out}/{table}").count() == 3


def test_a_new_subscription_joins_the_running_stream(spark, tmp_path):
    src, subs, out = (str(tmp_path / n) for n in ("src", "subs", "out"))
    schema = "id long, symbol string, exchange string, timestamp timestamp_ntz"
    put(spark, src, [(1, "A", "X", at(1)), (2, "B", "X", at(2))], schema)
    put(spark, src, [(3, "A", "X", at(3)), (4, "B", "X", at(4))], schema)
    put(spark, subs, [("A", "X")], "symbol string, exchange string")
    reads = []

    def load():
        if reads:   # a request arrives while the stream runs
            put(spark, subs, [("B", "X")], "symbol string, exchange string")
        reads.append(1)
        return spark.read.parquet(subs)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.run_to_completion(jobs.subscribed_ingest(stream, load, out, str(tmp_path / "c")))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 3, 4]


def test_alert_cool_down_crosses_batches_and_keeps_its_payload(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "entity string, alert_type string, severity string, metric string, value double, ts timestamp_ntz"
    for i in range(4):
        put(spark, src, [("e", "t", "warning", "m", float(j), at(100 * j)) for j in range(5 * i, 5 * i + 5)], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.run_to_completion(jobs.write_batches(jobs.alert_stream(stream, "250 seconds"), out, str(tmp_path / "c")))
    got = sorted((r.value, r.ts, r.severity) for r in spark.read.parquet(out).collect())
    assert got == [(float(j), at(100 * j), "warning") for j in range(0, 20, 3)]


# ------------------------------------------------------------------ T5: the book as map state

DEPTH = ("id long, symbol string, side string, level int, price decimal(20,8), size int, order_count int, "
         "timestamp timestamp_ntz")


def book_rows(*rows):
    return [(i, symbol, side, level, Decimal(price), 1, None, at(second)) for i, symbol, side, level, price, second in rows]


def run_book(spark, tmp_path, out="out"):
    stream = spark.readStream.schema(DEPTH).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    q = jobs.write_batches(book.book_changes(stream, "60 seconds", "10 seconds"), str(tmp_path / out), str(tmp_path / "c"), "update")
    jobs.run_to_completion(q)
    return q


def test_book_writes_changed_levels_and_expires_by_timer_across_a_restart(spark, tmp_path):
    src = str(tmp_path / "src")
    put(spark, src, book_rows(*((i, s, side, n, i, i % 5) for i, (s, side, n) in enumerate(
        (s, side, n) for s in "AB" for side in "BS" for n in range(1, 11)))), DEPTH)
    put(spark, src, book_rows((100, "A", "B", 3, 7, 30), (101, "A", "B", 3, 8, 31), (102, "A", "B", 3, 6, 29)), DEPTH)
    q = run_book(spark, tmp_path)
    written = [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"]]
    assert written[0] >= 40 and written[1] <= 3     # one level and the symbol's span, not the book
    log = spark.read.parquet(str(tmp_path / "out"))
    assert log.where("batch_id = 1").count() == 1 and book.current_book(log).count() == 40
    assert book.current_book(log).where("symbol = 'A' and side = 'B' and level = 3").first().price == 8
    # the job starts anew from its checkpoint: A moves on, B falls silent and goes by timer alone
    put(spark, src, book_rows((103, "A", "S", 1, 9, 64)), DEPTH)
    put(spark, src, book_rows((104, "A", "S", 2, 9, 140), (105, "A", "S", 9, 1, 20)), DEPTH)
    run_book(spark, tmp_path)
    log = spark.read.parquet(str(tmp_path / "out"))
    now = {(r.symbol, r.side, r.level, r.timestamp) for r in book.current_book(log).collect()}
    assert now == {("A", "S", 2, at(140))}
    gone = log.where("removed and symbol = 'B'")
    assert gone.count() == 20 and gone.select("batch_id").distinct().count() >= 1
    assert log.where("symbol = 'B' and not removed").agg({"batch_id": "max"}).first()[0] == 0


def test_book_equals_the_batch_rule_for_rows_of_one_batch_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    rows = book_rows(*((i, rng.choice("AB"), rng.choice("BS"), rng.randint(1, 4), i, rng.randint(0, 100)) for i in range(400)))
    newest, last = {}, {}
    for r in sorted(rows, key=lambda r: (r[7], r[0])):
        last[r[1:4]] = r
        newest[r[1]] = r[7]
    want = {(k, r[0]) for k, r in last.items() if r[7] >= newest[k[0]] - dt.timedelta(seconds=60)}
    rng.shuffle(rows)
    put(spark, str(tmp_path / "src"), rows, DEPTH)
    run_book(spark, tmp_path)
    got = {((r.symbol, r.side, r.level), r.id) for r in book.current_book(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == want


def test_a_backlog_of_feed_files_is_bounded_by_bytes(spark, tmp_path):
    src, out, ckpt = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    os.makedirs(src)
    for i in range(6):
        with open(f"{src}/{i}.json", "w") as f:
            f.write('{"type": "QUOTE", "symbol": "A", "timestamp": "2024-01-01T00:00:00", "bid_price": 1, "bid_size": %d}\n' % i)
    size = os.path.getsize(f"{src}/0.json")
    q = jobs.ingest_feed(spark, src, out, ckpt, max_bytes=3 * size)
    jobs.run_to_completion(q)
    got = spark.read.parquet(f"{out}/quotes")
    assert sorted(r.bid_size for r in got.collect()) == list(range(6))
    assert got.select("batch_id").distinct().count() == 2


def test_alerts_of_a_feed_without_any_are_an_empty_stream(spark, tmp_path):
    from marketlake.plans import catalog
    events = [(i, at(i), i, "click", 1.0, '{"k": 1}') for i in range(10)]     # ten ticks in the hour: no alert
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
                          ).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.queries()["T8_alert_stream"](spark, str(tmp_path))
    assert got.columns == ["entity", "alert_type", "severity", "metric", "value", "ts"] and got.count() == 0
