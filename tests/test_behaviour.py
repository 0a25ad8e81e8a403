"""Behaviour that the fixture views cannot show: multi-exchange symbols,
idempotent restore, purge counts, retention, SQL surface, DDL."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import SMALL
from marketlake import fixtures as fx
from marketlake.operators import depth as dp, joins, normalize as nz
from marketlake.plans import lifecycle as lc
from marketlake.plans.views import register_views
from marketlake.schemas import create_table_ddl
from marketlake.session import scratch_path

T0 = dt.datetime(2024, 1, 2, 12, 0)


def _ticks(spark, rows):
    return spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, symbol string, exchange string, "
                                       "price decimal(20,8), size int")


def test_directory_multi_exchange_and_missing_side(spark):
    ticks = _ticks(spark, [(1, T0, "ES", "CME", Decimal(1), 1), (2, T0 + dt.timedelta(minutes=5), "ES", "GLBX", Decimal(1), 2),
                           (3, T0, "NQ", "CME", Decimal(2), 1)])
    depth = spark.createDataFrame([(1, T0, "ZN", "B", 1)], "id long, timestamp timestamp_ntz, symbol string, side string, level int")
    out = {r.symbol: r for r in joins.symbol_directory(ticks, depth, T0 + dt.timedelta(hours=1)).collect()}
    assert (out["ES"].exchange, out["ES"].tick_count) == ("GLBX", 2)       # newest exchange, summed counts
    assert (out["ZN"].exchange, out["ZN"].tick_count, out["ZN"].level2_count) == ("Unknown", 0, 1)
    assert out["NQ"].level2_count == 0 and out["NQ"].last_level2_update is None


def test_insert_missing_is_idempotent(spark):
    cur = _ticks(spark, [(1, T0, "ES", "CME", Decimal(1), 1)])
    inc = _ticks(spark, [(1, T0, "ES", "CME", Decimal(9), 9), (2, T0, "ES", "CME", Decimal(2), 2),
                         (2, T0, "ES", "CME", Decimal(2), 2)])
    once = joins.insert_missing(cur, inc, ["id"])
    twice = joins.insert_missing(once, inc, ["id"])
    assert sorted((r.id, r.size) for r in twice.collect()) == [(1, 1), (2, 2)]


def test_upsert_keeps_exchange_and_touches(spark):
    cur = fx.symbols(spark)
    inc = spark.createDataFrame([("signup", "NYMEX"), ("newone", None)], "symbol string, exchange string")
    out = {r.symbol: r for r in joins.upsert_symbols(cur, inc, T0).collect()}
    assert out["SIGNUP"].active and out["SIGNUP"].exchange == "CBOT" and out["SIGNUP"].updated_at == T0
    assert out["NEWONE"].id == 7 and out["NEWONE"].exchange == "CME" and out["NEWONE"].created_at == T0
    assert out["IDLE"].updated_at == dt.datetime(2024, 1, 1)


def test_purge_counts_and_retention(spark):
    t = fx.ticks(spark, SMALL)
    a = t.agg(F.max("timestamp")).first()[0]
    kept, deleted = lc.purge(t, lc.retention_cutoff(a, 10))
    assert kept.count() + deleted.first().deleted_rows == t.count()
    plan = lc.partition_retention(t, 7, 3, a)
    kept_rows = lc.apply_retention(t, plan)
    assert kept_rows.count() == plan.filter("keep").agg(F.sum("rows")).first()[0]
    assert plan.filter("rank <= 3").filter(~F.col("keep")).count() == 0


def test_shape_rows_on_wide_depth(spark):
    d = fx.depth(spark, SMALL)
    wide = dp.long_to_wide(d, ("symbol", "timestamp", "msg_id"))
    shaped = nz.shape_rows(wide.limit(5))
    row = shaped.first()
    assert isinstance(row.timestamp, str) and "T" in row.timestamp
    assert isinstance(row.bids, list) and isinstance(row.asks, list)


def test_sql_views(spark):
    names = register_views(spark, SMALL)
    assert "latest_market_depth" in names
    n = spark.sql("SELECT count(*) AS n FROM latest_market_depth").first().n
    assert n == dp.latest_depth(fx.depth(spark, SMALL)).count()
    top = spark.sql("SELECT symbol, sum(total_delta) AS d FROM volume_profile_summary GROUP BY symbol").collect()
    assert len(top) > 0


def test_create_table_ddl(spark):
    loc = scratch_path(spark, "ddl")
    spark.sql("DROP TABLE IF EXISTS depth")
    spark.sql(create_table_ddl("depth", loc))
    cols = [r.col_name for r in spark.sql("DESCRIBE TABLE depth").collect()]
    assert "date" in cols and "side" in cols
    spark.sql("DROP TABLE depth")


def test_export_files_are_globally_ordered(spark):
    """Range partitions + in-partition sort -> part files in name order are in time order."""
    import glob
    import os
    t = fx.ticks(spark, SMALL)
    path = scratch_path(spark, "ordered")
    n = lc.export_ticks(t, path)
    assert n == t.count()
    local = path.replace("file:", "")
    parts = sorted(glob.glob(os.path.join(local, "part-*.csv")))
    assert len(parts) >= 1
    stamps = []
    for p in parts:
        with open(p) as fh:
            lines = fh.read().splitlines()[1:]
        stamps += [ln.split(",")[1] for ln in lines]
    assert stamps == sorted(stamps) and len(stamps) == n


def test_freshness_missing_table_and_json_rows(spark):
    from marketlake.operators import stats
    t = fx.ticks(spark, SMALL)
    a = t.agg(F.max("timestamp")).first()[0]
    got = {r.table_name: r.healthy for r in stats.freshness({"ticks": t, "symbol_metadata": None}, a).collect()}
    assert got == {"ticks": True, "symbol_metadata": False}
    js = nz.to_json_rows(t.limit(1)).first().json
    assert js.startswith("{") and '"price":' in js and "T" in js


def test_asof_tolerance(spark):
    from marketlake.operators import flow
    tr = _ticks(spark, [(1, T0, "ES", "CME", Decimal(1), 1), (2, T0 + dt.timedelta(minutes=10), "ES", "CME", Decimal(1), 1)])
    q = spark.createDataFrame([(9, T0 - dt.timedelta(seconds=30), "ES", Decimal("0.5"), Decimal("1.5"), 1, 1)],
                              "id long, timestamp timestamp_ntz, symbol string, bid_price decimal(20,8), "
                              "ask_price decimal(20,8), bid_size int, ask_size int")
    got = {r.id: r.bid_price for r in flow.asof_quotes(tr.select("id", "timestamp", "symbol", "size"), q,
                                                          tolerance="1 minute").collect()}
    assert got == {1: Decimal("0.5"), 2: None}


def test_purge_table_touches_one_day(spark):
    import uuid
    t = fx.ticks(spark, SMALL)
    a = t.agg(F.max("timestamp")).first()[0]
    cutoff = a - dt.timedelta(days=12, hours=5)
    name = f"t_{uuid.uuid4().hex[:8]}"
    lc.save_partitioned(t, name)
    later = (cutoff + dt.timedelta(days=2)).date().isoformat()
    files_before = sorted(spark.table(name).filter(F.col("date") == later).inputFiles())
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")   # must not matter
    try:
        deleted = lc.purge_table(spark, name, cutoff)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    assert deleted == t.filter(F.col("timestamp") < F.lit(cutoff)).count()
    kept = spark.table(name)
    assert kept.count() == t.count() - deleted
    assert kept.agg(F.min("timestamp")).first()[0] >= cutoff
    assert sorted(spark.table(name).filter(F.col("date") == later).inputFiles()) == files_before
    spark.sql(f"DROP TABLE {name}")


def test_cluster_conf_sizes_partitions():
    from marketlake.session import cluster_conf
    conf = cluster_conf(100 * 1024 ** 4)
    assert int(cluster_conf(10 * 1024 ** 3)["spark.sql.shuffle.partitions"]) == 8000   # 2 waves of 4000 cores
    assert int(conf["spark.sql.shuffle.partitions"]) == 40_000         # 10 waves at most


def test_latest_time_reads_newest_partition(spark):
    import uuid
    from marketlake.sources.tables import latest_time
    t = fx.ticks(spark, SMALL)
    name = f"t_{uuid.uuid4().hex[:8]}"
    lc.save_partitioned(t, name)
    assert latest_time(spark, name) == t.agg(F.max("timestamp")).first()[0]
    spark.sql(f"DROP TABLE {name}")


def test_thousands_and_human_size(spark):
    from marketlake.functions.timefn import human_size
    df = spark.createDataFrame([(1234567, 5 * 1024 ** 3)], "n long, b long")
    row = nz.with_thousands(df, ["n"]).select("n", human_size("b").alias("h")).first()
    assert row.n == "1,234,567" and row.h == "5.0 GB"


def test_interrupted_archive_loses_nothing(spark, tmp_path, monkeypatch):
    """A purge that dies after some partitions, then the job once more: every row is archived or kept."""
    import datetime as dt
    from pyspark.sql import functions as F
    from marketlake.plans import lifecycle as lc
    from marketlake.sources.archive import read_archive
    base = dt.datetime(2024, 1, 1)
    df = spark.range(1000).select("id", F.timestamp_add("MINUTE", F.col("id") * 20, F.lit(base)).alias("timestamp"))
    cutoff = base + dt.timedelta(days=9, hours=5)
    lc.save_partitioned(df, "interrupted_archive")
    purge = lc.purge_table

    def dies(spark_, table, *rest):
        for day in lc._partition_days(spark_, table)[:5]:
            spark_.sql(f"ALTER TABLE {table} DROP PARTITION (date='{day.isoformat()}')")
        raise RuntimeError("lost")

    path = str(tmp_path / "archive")
    try:
        monkeypatch.setattr(lc, "purge_table", dies)
        try:
            lc.archive_table(spark, "interrupted_archive", cutoff, path, base)
        except RuntimeError:
            pass
        monkeypatch.setattr(lc, "purge_table", purge)
        lc.archive_table(spark, "interrupted_archive", cutoff, path, base)
        archived = {r["id"] for r in read_archive(spark, path, {"interrupted_archive": df.schema})
                    ["interrupted_archive"].collect()}
        kept = {r["id"] for r in spark.table("interrupted_archive").collect()}
        assert archived | kept == set(range(1000)) and not archived & kept
        assert archived == {i for i in range(1000) if base + dt.timedelta(minutes=20 * i) < cutoff}
    finally:
        spark.sql("DROP TABLE IF EXISTS interrupted_archive")


def test_depth_time_filters_reach_the_scan(spark, capsys):
    from marketlake.plans import catalog
    for name in ("A6_depth_activity", "A8_live_depth_levels", "J2_symbol_directory"):
        catalog.queries()[name](spark, SMALL).explain("formatted")
        pushed = [line for line in capsys.readouterr().out.split("\n") if "PushedFilters" in line]
        assert pushed and all("GreaterThan" in line and "(ts," in line for line in pushed), (name, pushed)


def test_sliding_windows_take_panes(spark, capsys):
    from marketlake.operators import rollup
    from marketlake.streaming import jobs, live
    ticks = spark.createDataFrame([(1, T0, "ES", Decimal(1))], "id long, timestamp timestamp_ntz, symbol string, price decimal(20,8)")
    pane = rollup.activity(live.pane_length("1 minute", "2 seconds"))
    panes = jobs.live_stats_stream(ticks, pane.period).withColumnsRenamed({"window_start": "period_start", "window_end": "period_end"})
    rollup.sliding(pane, panes, "1 minute", "2 seconds").explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    # the expansion into windows stands above the first aggregate
    assert plan.count("Aggregate") == 2 and plan.rindex("Aggregate") > plan.index("Expand")
