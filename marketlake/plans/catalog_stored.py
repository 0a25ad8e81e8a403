"""Registered queries over stored layouts: day tables with file statistics and Bloom filters, refreshed results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .. import fixtures as fx, schemas
from ..operators import filters, rollup, stats
from ..session import scratch_path
from ..sources import daytables as days
from ..streaming import jobs
from . import refresh
from .catalog import _as_of, register
from .catalog_io import _HOUR_BARS, _HOUR_PROFILE
from .oracle_views import AS_OF

_TABLES = {"ticks": fx.ticks, "depth": fx.depth}


def _day_tables(spark, base, names=tuple(_TABLES)) -> dict[str, str]:
    paths = {n: scratch_path(spark, f"days-{n}") for n in names}
    for name, path in paths.items():
        days.write_day_table(_TABLES[name](spark, base), path, key="id")
    return paths


@register("A1_stored_counts", """
    SELECT 'ticks' AS table_name, count(*) AS row_count FROM ticks UNION ALL SELECT 'depth', count(*) FROM depth""")
def q_a1_stored(spark, base):
    return days.stored_counts(spark, _day_tables(spark, base))


@register("A3_stored_range", """
    SELECT 'ticks' AS table_name, count(*) AS total_rows, min("timestamp") AS earliest, max("timestamp") AS latest FROM ticks
    UNION ALL SELECT 'depth', count(*), min("timestamp"), max("timestamp") FROM depth""")
def q_a3_stored(spark, base):
    return days.stored_range(spark, _day_tables(spark, base))


@register("A4_stored_recent", f"""
    SELECT 'ticks' AS table_name, count(*) AS recent_rows FROM ticks WHERE "timestamp" > {AS_OF} - INTERVAL 30 HOUR
    UNION ALL SELECT 'depth', count(*) FROM depth WHERE "timestamp" > {AS_OF} - INTERVAL 30 HOUR""")
def q_a4_stored(spark, base):
    return days.stored_recent(spark, _day_tables(spark, base), _as_of(spark, base), "30 hours")


@register("A12_stored_freshness", f"""
    SELECT 'ticks' AS table_name, max("timestamp") > {AS_OF} - INTERVAL 5 MINUTE AS healthy FROM ticks
    UNION ALL SELECT 'depth', max("timestamp") > {AS_OF} - INTERVAL 5 MINUTE FROM depth""")
def q_a12_stored(spark, base):
    return days.stored_freshness(spark, _day_tables(spark, base), _as_of(spark, base))


@register("O1_newest_from_days", """
    SELECT * FROM (SELECT * FROM ticks WHERE symbol = 'CLICK' ORDER BY "timestamp" DESC, id DESC LIMIT 100)
    UNION ALL SELECT * FROM (SELECT * FROM ticks WHERE symbol = 'ERROR' ORDER BY "timestamp" DESC, id DESC LIMIT 1000)""")
def q_o1_days(spark, base):
    path = _day_tables(spark, base, ("ticks",))["ticks"]
    few, _ = days.newest_rows(spark, path, 100, F.col("symbol") == "CLICK")
    many, _ = days.newest_rows(spark, path, 1000, F.col("symbol") == "ERROR")
    return few.unionByName(many).drop(days.TS_US)


def _replayed(spark, base) -> str:
    """Ticks in four batches by age; then the oldest comes again, and a batch that overlaps two others."""
    path, t = scratch_path(spark, "replay"), fx.ticks(spark, base)
    day = F.datediff(F.to_date("timestamp"), F.lit("2024-01-01").cast("date"))
    batches = [t.where(day < 8), t.where(day.between(8, 15)), t.where(day.between(16, 23)), t.where(day >= 24)]
    for n, batch in enumerate([*batches, batches[0], t.where(day.between(6, 10))]):
        days.insert_new(spark, path, batch, n)
    return path


@register("T9_replay_weeks_later", "SELECT * FROM ticks")
def q_t9_replay(spark, base):
    return days.read_day_table(spark, _replayed(spark, base)).drop("date", "batch_id")


def _batches(spark, base, name: str, order: list[int]) -> str:
    """Ticks as a table of batch folders; ``order`` says which batches arrive, some twice."""
    path, t = scratch_path(spark, name), fx.ticks(spark, base)
    for n in order:
        jobs.write_batch_once(t.where(F.col("id") % 5 == n), path, n)
    return path


def _kept_up(spark, base, what: rollup.Rollup, name: str) -> DataFrame:
    source = _batches(spark, base, f"{name}-src", [0, 1])
    store = scratch_path(spark, f"{name}-store")
    refresh.refresh(spark, source, store, what)
    t = fx.ticks(spark, base)
    for some in ([2, 3], [1, 4]):   # batch 1 is run again
        for n in some:
            jobs.write_batch_once(t.where(F.col("id") % 5 == n), source, n)
        refresh.refresh(spark, source, store, what)
    return refresh.refreshed(spark, store, what)


@register("A14_bars_refreshed", _HOUR_BARS)
def q_a14_refreshed(spark, base):
    return _kept_up(spark, base, rollup.bars("1 hour"), "bars-kept")


@register("A13_profile_refreshed", _HOUR_PROFILE)
def q_a13_refreshed(spark, base):
    return _kept_up(spark, base, rollup.profile("1 hour"), "profile-kept")


@register("S2_table_by_ddl", "SELECT * FROM ticks")
def q_s2(spark, base):
    """A table created by its definition, written and read through the catalog; its columns and types are the schema's."""
    ddl = schemas.create_table_ddl("ticks", scratch_path(spark, "ddl-ticks"))
    name = f"ticks_{uuid.uuid4().hex}"
    spark.sql(ddl.replace("EXISTS ticks ", f"EXISTS {name} ", 1))
    rows = schemas.conform(fx.ticks(spark, base), schemas.SCHEMAS["ticks"])
    before = spark.conf.get("hive.exec.dynamic.partition.mode", None)
    spark.conf.set("hive.exec.dynamic.partition.mode", "nonstrict")
    try:
        rows.withColumn("date", F.to_date("timestamp")).write.insertInto(name)
    finally:
        if before is None:
            spark.conf.unset("hive.exec.dynamic.partition.mode")
        else:
            spark.conf.set("hive.exec.dynamic.partition.mode", before)
    return spark.table(name).select(*fx.ticks(spark, base).columns)


@register("A11_all_actions", """
    SELECT count(*) AS total, count(*) FILTER (WHERE id % 4 = 0) AS add_count, count(*) FILTER (WHERE id % 4 = 1) AS modify_count,
           count(*) FILTER (WHERE id % 4 = 2) AS delete_count, count(*) FILTER (WHERE id % 4 = 3) AS fill_count
    FROM order_updates""")
def q_a11_all(spark, base):
    """All four actions occur (the actions of the view are only two)."""
    actions = ["ADD", "MODIFY", "DELETE", "FILL"]
    rows = fx.order_updates(spark, base).withColumn("action", F.get(F.array(*map(F.lit, actions)), (F.col("id") % 4).cast("int")))
    return stats.status_counts(rows, "action", actions)


@register("F6_side_rows", """
    SELECT 'bid' AS part, id, symbol, level, CAST(price AS DOUBLE) AS price, size FROM depth WHERE side = 'B'
    UNION ALL SELECT 'ask', id, symbol, level, CAST(price AS DOUBLE), size FROM depth WHERE side = 'S'""")
def q_f6_rows(spark, base):
    bids, asks = filters.split_sides(fx.depth(spark, base))
    some = lambda df, part: df.select(F.lit(part).alias("part"), "id", "symbol", "level",
                                      F.col("price").cast("double").alias("price"), "size")
    return some(bids, "bid").unionByName(some(asks, "ask"))
