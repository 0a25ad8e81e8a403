"""Hand-written golden rows for the ingest paths (FIXTURES.md part A)."""

import datetime as dt
import struct
from decimal import Decimal

from pyspark.sql import functions as F

from marketlake import frame_fixtures as ff
from marketlake.functions.exchange import exchange_for
from marketlake.operators import depth as dp, normalize as nz
from marketlake.schemas import enforce
from marketlake.sources import frames as fr, json_feed as jf


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_json_feed_parse_route_and_rejects(spark):
    feed = lines(spark, [
        '{"type": "TICK", "symbol": "ESZ5", "price": 4500.25, "size": 3, "timestamp": "2024-01-02T03:04:05.123456"}',
        '{"type": "QUOTE", "symbol": "ESZ5", "bid_price": 0, "ask_price": 4500.5, "bid_size": 1, "ask_size": 2}',
        '{"type": "DEPTH", "symbol": "ESZ5", "bids": [], "asks": []}',
        '{"type": "STATUS", "msg": "ok"}', '{"type": "NOPE"}', '{"type": "TICK", "symbol": ', "   ",
    ])
    good, bad = jf.parse_lines(feed)
    routes = jf.route(good)
    assert {k: v.count() for k, v in routes.items()} == {"tick": 1, "quote": 1, "depth": 1, "log": 1, "unknown": 1}
    assert bad.count() == 1
    tick = nz.normalize_ticks(routes["tick"]).first()
    assert tick.exchange == "CME"                      # missing exchange -> CME
    assert tick.price == Decimal("4500.25000000")
    assert tick.timestamp == dt.datetime(2024, 1, 2, 3, 4, 5, 123456)
    assert tick.bid_price is None                      # missing bid -> NULL
    quote = nz.normalize_quotes(routes["quote"]).first()
    assert quote.bid_price is None and quote.ask_price == Decimal("4500.5")   # bid 0 -> NULL


def test_missing_timestamp_uses_arrival(spark):
    good, _ = jf.parse_lines(lines(spark, ['{"type": "TICK", "symbol": "X", "price": 1}']))
    row = nz.normalize_ticks(good, arrival=F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")).first()
    assert row.timestamp == dt.datetime(2030, 1, 1)
    assert row.size == 0


def test_depth_levels_cut_and_defaults(spark):
    bids = ", ".join(f'{{"price": {100 - i}, "size": {i + 1}}}' for i in range(12))
    good, _ = jf.parse_lines(lines(spark, [
        f'{{"type": "DEPTH", "symbol": "NQU5", "timestamp": "2024-01-01T00:00:00", "bids": [{bids}], "asks": []}}']))
    long = dp.to_long_depth(good, max_levels=10).orderBy("side", "level").collect()
    assert len(long) == 10 and [r.level for r in long] == list(range(1, 11))
    assert long[0].price == Decimal("100") and long[0].order_count is None
    wide = dp.to_wide_depth(good).first()
    assert wide.depth == 10 and len(wide.asks) == 0 and wide.bids[0].num_orders == 0
    binary = dp.to_long_depth(good, max_levels=None, order_count_default=1)
    assert binary.count() == 12 and binary.filter("order_count = 1").count() == 12


def test_wide_long_round_trip(spark):
    rows = [(1, dt.datetime(2024, 1, 1), "ES", "B", 1, Decimal("1.5"), 3, 2),
            (2, dt.datetime(2024, 1, 1), "ES", "S", 1, Decimal("1.75"), 4, 1)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, symbol string, side string, "
                                     "level int, price decimal(20,8), size int, order_count int")
    back = dp.wide_to_long(dp.long_to_wide(df)).select(*df.columns)
    assert sorted(back.collect()) == sorted(df.collect())


def test_v1_library_tick(spark):
    raw = spark.createDataFrame([("GCQ5", None, "7", 1, None, "COMEX"), ("GCQ5", "2.5", None, 2, "T", None)],
                                "symbol string, last_trade_price string, last_trade_size string, "
                                "aggressor_side int, trade_type string, exchange string")
    out = nz.normalize_ticks_v1(raw, arrival=F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert (out[0].price, out[0].volume, out[0].direction, out[0].trade_type) == (0.0, 7, "buy", "")
    assert (out[1].price, out[1].volume, out[1].direction, out[1].exchange) == (2.5, 0, "sell", "")


def test_exchange_prefix_golden(spark):
    syms = ["GCQ5", "MGCQ5", "CLU5", "ZZZ1", "6EU5", "YMZ5", "PLN5"]
    df = spark.createDataFrame([(s,) for s in syms], "symbol string").select("symbol", exchange_for("symbol").alias("e"))
    got = dict(df.collect())
    assert got == {"GCQ5": "COMEX", "MGCQ5": "COMEX", "CLU5": "NYMEX", "ZZZ1": "CME", "6EU5": "CME",
                   "YMZ5": "CBOT", "PLN5": "NYMEX"}


def test_parse_symbols(spark):
    df = spark.createDataFrame([(" es:cme, nq ,, GC:COMEX ",)], "symbols string")
    assert sorted(map(tuple, nz.parse_symbols(df).collect())) == [("ES", "CME"), ("GC", "COMEX"), ("NQ", "CME")]


def _frame(t, body):
    return struct.pack(">IH", len(body) + 2, t) + body


def _trade(sym, price, size, ms):
    s = sym.encode()
    return _frame(102, struct.pack(">I", len(s)) + s + struct.pack(">dIQ", price, size, ms))


def _quote(sym, b, bs, a, az):
    s = sym.encode()
    return _frame(103, struct.pack(">I", len(s)) + s + struct.pack(">dIdI", b, bs, a, az))


def test_binary_frames_golden(spark):
    rows = [(1, _trade("ESZ5", 4500.25, 3, 1_700_000_000_123)), (2, _trade("GCQ5", -1.5, 1, 0)),
            (3, _trade("ABC", 1.0, 1, 5)),            # 27-byte body: decoded (>= 24)
            (4, _quote("NQU5", 15000.5, 2, 15001.0, 4)),
            (5, _quote("NQU", 1.0, 2, 2.0, 4)),       # 31-byte body: below 32 -> type only
            (6, _frame(109, b"")), (7, _frame(999, b"xx")),
            (8, _trade("ESZ5", 1.0, 1, 1)[:-3]),      # truncated -> reject
            (9, _trade("ESZ5", 5e-324, 7, 2))]        # subnormal double
    dec, rej = fr.decode_frames(spark.createDataFrame(rows, "id long, frame binary"))
    got = {r.id: r for r in dec.collect()}
    assert got[1].price == 4500.25 and got[1].size == 3
    assert got[1].timestamp == dt.datetime(2023, 11, 14, 22, 13, 20, 123000)
    assert got[2].price == -1.5 and got[3].symbol == "ABC"
    assert (got[4].bid_price, got[4].ask_size) == (15000.5, 4)
    assert got[5].type_name == "BID_OFFER" and got[5].symbol is None
    assert (got[6].type_name, got[7].type_name) == ("MARKET_DEPTH_UPDATE", "UNKNOWN")
    assert got[9].price == 5e-324
    assert [r.id for r in rej.collect()] == [8]
    strict = nz.normalize_ticks_strict(dec).collect()
    assert {r.id: r.exchange for r in strict} == {1: "CME", 2: "COMEX", 3: "CME", 9: "CME"}
    assert all(r.aggressor_side is None for r in strict)


def test_enforce_rejects(spark):
    df = spark.createDataFrame([(1, "B", 1, Decimal("1"), 1), (2, "X", 1, Decimal("1"), 1),
                                (3, "S", None, Decimal("1"), 1)],
                               "id long, side string, level int, price decimal(20,8), size int") \
        .withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("symbol", F.lit("ES")) \
        .withColumn("implied_size", F.lit(None).cast("int"))
    ok, rej = enforce(df, "depth")
    assert [r.id for r in ok.collect()] == [1] and ok.first().implied_size == 0
    assert sorted((r.id, r.reject_reason) for r in rej.collect()) == [(2, "side not in B,S"), (3, "level is null")]


def test_enforce_defaults_and_absent_columns(spark):
    df = spark.createDataFrame([(1, None)], "id long, buy_volume long").withColumn("symbol", F.lit("ES"))
    ok, rej = enforce(df.withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz")), "volume_profile")
    assert ok.count() == 0 and rej.first().reject_reason == "price_level is null" and rej.first().buy_volume == 0
    stats = df.withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("period_minutes", F.lit(None).cast("int"))
    assert enforce(stats, "market_stats")[0].first().period_minutes == 1


def test_double_bytes_native_round_trip(spark):
    import math
    import random
    rnd = random.Random(3)
    vals = [0.0, -0.0, 1.0, -1.5, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308,
            float("inf"), float("-inf"), 0.1, 6.55] + [rnd.uniform(-1e9, 1e9) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    rows = df.select("x", ff.f64_bytes(F.col("x")).alias("b"), ff.f64(ff.f64_bytes(F.col("x")), 1).alias("y")).collect()
    for r in rows:
        assert bytes(r.b) == struct.pack(">d", r.x)
        assert r.y == r.x and math.copysign(1, r.y) == math.copysign(1, r.x)


def test_bad_frames_are_rejects_with_a_reason(spark):
    good = _trade("ESZ5", 1.0, 1, 1)
    rows = [(0, good), (1, b"\xff\xff\xff\xff" + good[4:]),
            (2, _frame(102, b"\xff\xff\xff\xff" + good[10:])), (3, _frame(102, struct.pack(">I", 1000) + good[10:])),
            (4, _frame(102, struct.pack(">I", 4) + b"\xff\xfe\xfd\xfc" + good[14:])),
            (5, _trade("ESZ5", 1.0, 1, 2 ** 63)), (6, _trade("ESZ5", 1.0, 1, 2 ** 60)), (7, _trade("ESZ5", 1.0, 2 ** 31, 1)),
            (8, _trade("ESZ5", 1e300, 1, 1)), (9, _trade("ESZ5", float("nan"), 1, 1)),
            (10, _quote("NQU5", 1.0, 2, float("inf"), 4)), (11, b""), (12, None), (13, b"\x00\x00\x00\x01\x00\x66")]
    dec, rej = fr.decode_frames(spark.createDataFrame(rows, "id long, frame binary"))
    assert [r.id for r in nz.normalize_ticks_strict(dec).collect()] == [0]
    short, size = "truncated frame", "size out of range"
    assert {r.id: r.reject_reason for r in rej.collect()} == {
        1: short, 2: short, 3: short, 4: "symbol is no UTF-8", 5: "time out of range", 6: "time out of range", 7: size,
        8: "price out of range", 9: "price out of range", 10: "price out of range", 11: short, 12: short, 13: short}


def test_feed_numbers_offsets_and_rejects(spark):
    feed = lines(spark, [
        '{"type": "TICK", "symbol": "A", "price": "4500.25", "size": 3.0, "timestamp": "2024-01-02T03:04:05+05:00"}',
        '{"type": "TICK", "symbol": "B", "price": 1e300}', '{"type": "TICK", "symbol": "C", "price": 1, "bid_size": 5000000000}',
        '{"type": "TICK", "symbol": "D", "price": "NaN"}', '{"type": "TICK", "symbol": "E", "price": {"a": 1}}',
        '{"type": "DEPTH", "symbol": "F", "bids": "none"}', '[1, 2]', '{"type":',
        '{"type": "TICK", "symbol": "G", "price": 2, "timestamp": "2024-01-02T03:04:05Z"}',
        '{"type": "TICK", "symbol": "H", "price": 2, "timestamp": "2024-01-02"}'])
    good, bad = jf.parse_lines(feed)
    ticks = {r.symbol: r for r in nz.normalize_ticks(good).collect()}
    assert set(ticks) == {"A", "G", "H"} and ticks["A"].price == Decimal("4500.25") and ticks["A"].size == 3
    assert ticks["A"].timestamp == dt.datetime(2024, 1, 1, 22, 4, 5)
    assert ticks["G"].timestamp == dt.datetime(2024, 1, 2, 3, 4, 5) and ticks["H"].timestamp == dt.datetime(2024, 1, 2)
    reasons = sorted(r.reject_reason for r in bad.collect())
    assert reasons == ["bad field", "bad field: bid_size", "bad field: price", "bad field: price", "bad field: price",
                       "invalid JSON", "invalid JSON"]
