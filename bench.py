"""Benchmark the headline operators at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each operator is forced with ``write.format("noop")`` (full evaluation, no
output cost): one warm-up run, then ``$BENCH_RUNS`` timed runs, median kept.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def headline():
    from marketlake import fixtures as fx
    from marketlake.functions.timefn import resolve_as_of
    from marketlake.operators import depth as dp, flow, joins, quality, stats, topk

    def as_of(spark, base):
        return resolve_as_of(fx.ticks(spark, base))

    return {
        "O1_recent_ticks": lambda s, b: topk.api_ticks(fx.ticks(s, b), "click"),
        "A2_symbol_stats": lambda s, b: stats.symbol_stats(fx.ticks(s, b)),
        "A3_table_stats": lambda s, b: stats.table_stats(fx.ticks(s, b), "ticks", as_of(s, b)),
        "J1_symbol_listing": lambda s, b: joins.symbol_listing(fx.symbols(s), fx.ticks(s, b)),
        "J2_symbol_directory": lambda s, b: joins.symbol_directory(fx.ticks(s, b), fx.depth(s, b)),
        "W1_latest_depth": lambda s, b: dp.latest_depth(fx.depth(s, b)),
        "A14_bars_1m": lambda s, b: flow.build_bars(fx.trades(s, b), "1 minute"),
        "A14_market_stats_1h": lambda s, b: flow.market_stats(fx.trades(s, b), fx.quotes(s, b),
                                                             fx.depth(s, b), "1 hour"),
        "A13_volume_profile": lambda s, b: flow.build_volume_profile(fx.ticks(s, b), "1 hour"),
        "J7_asof_quotes": lambda s, b: flow.asof_quotes(fx.trades(s, b), fx.quotes(s, b)),
        "W6_running_delta": lambda s, b: flow.running_delta(fx.ticks(s, b)),
        "W4_data_gaps": lambda s, b: quality.data_gaps(fx.ticks(s, b), "1 hour"),
        "M2_suppress": lambda s, b: quality.suppress(
            quality.evaluate_rules(fx.metrics(s, b), quality.rules_with(recent_ticks=4.0)), "3 hours"),
        "A19_order_state": lambda s, b: flow.order_state(fx.order_updates(s, b)),
        "JH_bars_lineitem_part": lambda s, b: flow.build_bars(fx.heavy_ticks(s, b), "1 day"),
        "JH_asof_lineitem_part": lambda s, b: flow.asof_quotes(
            fx.heavy_ticks(s, b).filter("aggressor_side IS NOT NULL"),
            fx.heavy_ticks(s, b).filter("aggressor_side IS NULL").select(
                "id", "timestamp", "symbol", F_price("bid_price"), F_price("ask_price"),
                F_size("bid_size"), F_size("ask_size"))),
    }


def F_price(name):
    from pyspark.sql import functions as F
    return F.col("price").alias(name)


def F_size(name):
    from pyspark.sql import functions as F
    return F.col("size").alias(name)


def ingest_inputs(spark):
    """Write the raw inputs of the ingest benchmarks once (untimed): the JSON
    feed as text files and the binary frames as a Parquet table."""
    from marketlake.plans.catalog_io import feed_lines
    from marketlake import fixtures as fx
    from marketlake.session import scratch_path
    from marketlake import frame_fixtures as ff
    feed = scratch_path(spark, "bench-feed")
    feed_lines(spark, SF_DIR).write.text(feed)
    frames = scratch_path(spark, "bench-frames")
    ff.encode_trade_frames(fx.trades(spark, SF_DIR)).unionByName(
        ff.encode_quote_frames(fx.quotes(spark, SF_DIR))).write.parquet(frames)
    return feed, frames


def ingest_ops(feed, frames):
    from pyspark.sql import functions as F
    from marketlake.operators import depth as dp, normalize as nz
    from marketlake.sources import frames as fr, json_feed as jf

    def feed_ticks(s, b):
        good, _ = jf.read_json_feed(s, feed)
        return nz.normalize_ticks(jf.route(good)["tick"])

    def feed_depth(s, b):
        good, _ = jf.read_json_feed(s, feed)
        return dp.to_long_depth(jf.route(good)["depth"], max_levels=10)

    def frame_ticks(s, b):
        dec, _ = fr.decode_frames(s.read.parquet(frames))
        return nz.normalize_ticks_strict(dec.filter(F.col("type_name") == "LAST_TRADE"))

    return {"S3_N2_feed_ticks": feed_ticks, "S3_N6_feed_depth": feed_depth, "S5_N3_frame_ticks": frame_ticks}


#: Timed once after one run to warm up, and not part of the headline total.
WRITERS = ("J4_upsert_symbols", "E1_export_ticks_csv", "E5_archive_table", "T4_live_stats_sliding", "T7_gap_stream")


def host_seconds() -> float:
    """A fixed piece of interpreter work: how fast this host is, to read the other figures by."""
    t0 = time.perf_counter()
    sum(i * i % 7 for i in range(10_000_000))
    return round(time.perf_counter() - t0, 3)


def main():
    from marketlake.plans import catalog
    from marketlake.session import build_session
    spark = build_session(f"local[{CPUS}]", int(CPUS) * 2, "marketlake-bench",
                          {"spark.driver.memory": "16g"})
    times, host = {}, host_seconds()
    ops = dict(headline())
    ops.update(ingest_ops(*ingest_inputs(spark)))
    for name, fn in ops.items():
        runs = []
        for i in range(RUNS + 1):
            t0 = time.perf_counter()
            fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    total = round(sum(times.values()), 3)
    for name in WRITERS:
        for _ in range(2):
            t0 = time.perf_counter()
            catalog.queries()[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median", "value": total,
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(CPUS), "runs": RUNS,
                      "host_seconds": host}))


if __name__ == "__main__":
    main()
