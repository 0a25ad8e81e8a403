"""Registered queries: one per operator of the inventory, each with its DuckDB
oracle. A query takes (spark, base_dir) and returns a DataFrame; the oracle is
SQL over the same Parquet tables, with the fixture views as CTEs.

Parameters that the reference reads from the clock (NOW()) use the newest
tick time of the input as ``as_of``, on both sides.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixtures as fx
from ..functions.exchange import exchange_for, with_exchange
from ..functions.timefn import resolve_as_of
from ..operators import depth as dp, filters as fl, flow, joins, normalize as nz, quality, stats, topk
from .oracle_views import AS_OF, with_views, exchange_case

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, with_views(sql) if sql is not None else None)
        return fn
    return deco


def _as_of(spark: SparkSession, base: str) -> dt.datetime:
    return resolve_as_of(fx.ticks(spark, base))


# ---------------------------------------------------------------- scans, filters, top-k

@register("S1_scan_ticks", "SELECT * FROM ticks")
def q_s1(spark, base):
    return fx.ticks(spark, base)


@register("F5_select_range", f"""
    SELECT * FROM ticks WHERE symbol = 'VIEW' AND "timestamp" > {AS_OF} - INTERVAL 3 DAY""")
def q_f5(spark, base):
    t = fx.ticks(spark, base)
    return fl.select_range(t, "view", days=3, as_of=_as_of(spark, base))


@register("F6_split_sides", """
    SELECT 'B' AS book_side, count(*) AS row_count, CAST(sum(size) AS BIGINT) AS total_size
    FROM depth WHERE side = 'B'
    UNION ALL
    SELECT 'S', count(*), CAST(sum(size) AS BIGINT) FROM depth WHERE side = 'S'""")
def q_f6(spark, base):
    bids, asks = fl.split_sides(fx.depth(spark, base))
    agg = lambda df, s: df.agg(F.count(F.lit(1)).alias("row_count"),
                               F.sum(F.col("size").cast("bigint")).alias("total_size")) \
        .select(F.lit(s).alias("book_side"), "row_count", "total_size")
    return agg(bids, "B").unionByName(agg(asks, "S"))


@register("O1_recent_ticks", """
    SELECT id, "timestamp", symbol, CAST(price AS DOUBLE) AS price, size AS volume,
           coalesce(lower(aggressor_side), 'sell') AS direction, CAST(NULL AS VARCHAR) AS trade_type,
           exchange
    FROM ticks WHERE symbol = 'CLICK' ORDER BY "timestamp" DESC, id DESC LIMIT 100""")
def q_o1(spark, base):
    return topk.api_ticks(fx.ticks(spark, base), "click")


@register("O2_recent_depth", """
    WITH snap AS (
        SELECT symbol, "timestamp", msg_id, count(*) FILTER (WHERE side = 'B') AS n_bids,
               count(*) FILTER (WHERE side = 'S') AS n_asks
        FROM depth WHERE symbol = 'VIEW' GROUP BY 1, 2, 3)
    SELECT "timestamp", symbol, msg_id, CAST(n_bids + n_asks AS INTEGER) AS depth, n_bids, n_asks
    FROM snap ORDER BY "timestamp" DESC, msg_id DESC LIMIT 50""")
def q_o2(spark, base):
    wide = dp.long_to_wide(fx.depth(spark, base), ("symbol", "timestamp", "msg_id"))
    top = topk.recent_depth(wide, "view", tie="msg_id")
    return top.select("timestamp", "symbol", "msg_id", "depth",
                      F.size("bids").cast("bigint").alias("n_bids"),
                      F.size("asks").cast("bigint").alias("n_asks"))


@register("O3_console_ticks", """
    SELECT id, "timestamp", symbol, price, size, CAST(NULL AS DECIMAL(20,8)) AS bid_price,
           CAST(NULL AS DECIMAL(20,8)) AS ask_price
    FROM ticks ORDER BY "timestamp" DESC, id DESC LIMIT 20""")
def q_o3(spark, base):
    return topk.console_ticks(fx.ticks(spark, base))


# ---------------------------------------------------------------- statistics

@register("A1_table_counts", """
    SELECT 'ticks' AS table_name, count(*) AS row_count FROM ticks
    UNION ALL SELECT 'quotes', count(*) FROM quotes
    UNION ALL SELECT 'depth', count(*) FROM depth
    UNION ALL SELECT 'order_updates', count(*) FROM order_updates""")
def q_a1(spark, base):
    return stats.table_counts({"ticks": fx.ticks(spark, base), "quotes": fx.quotes(spark, base),
                               "depth": fx.depth(spark, base),
                               "order_updates": fx.order_updates(spark, base)})


@register("A2_symbol_stats", """
    SELECT symbol, count(*) AS tick_count, min("timestamp") AS first_tick, max("timestamp") AS last_tick
    FROM ticks GROUP BY symbol""")
def q_a2(spark, base):
    return stats.symbol_stats(fx.ticks(spark, base))


@register("A3_table_stats", f"""
    SELECT 'ticks' AS table_name, count(*) AS total_rows, count(DISTINCT symbol) AS unique_symbols,
           min("timestamp") AS earliest, max("timestamp") AS latest,
           count(*) FILTER (WHERE "timestamp" > {AS_OF} - INTERVAL 1 HOUR) AS recent_rows
    FROM ticks
    UNION ALL
    SELECT 'depth', count(*), count(DISTINCT symbol), min("timestamp"), max("timestamp"),
           count(*) FILTER (WHERE "timestamp" > {AS_OF} - INTERVAL 1 HOUR)
    FROM depth""")
def q_a3(spark, base):
    a = _as_of(spark, base)
    return stats.table_stats(fx.ticks(spark, base), "ticks", a).unionByName(
        stats.table_stats(fx.depth(spark, base), "depth", a))


@register("A4_recent_counts", f"""
    SELECT 'ticks' AS table_name, count(*) FILTER (WHERE "timestamp" > {AS_OF} - INTERVAL 1 HOUR) AS recent_rows
    FROM ticks
    UNION ALL
    SELECT 'depth', count(*) FILTER (WHERE "timestamp" > {AS_OF} - INTERVAL 1 HOUR) FROM depth""")
def q_a4(spark, base):
    return stats.recent_counts({"ticks": fx.ticks(spark, base), "depth": fx.depth(spark, base)},
                               _as_of(spark, base), "1 hour")


@register("A5_tick_activity", f"""
    SELECT symbol, exchange, count(*) AS tick_count, max("timestamp") AS last_update
    FROM ticks WHERE "timestamp" > {AS_OF} - INTERVAL 24 HOUR GROUP BY symbol, exchange""")
def q_a5(spark, base):
    return stats.tick_activity(fx.ticks(spark, base), _as_of(spark, base))


@register("A6_depth_activity", f"""
    SELECT symbol, count(*) AS level2_count, max("timestamp") AS last_update
    FROM depth WHERE "timestamp" > {AS_OF} - INTERVAL 24 HOUR GROUP BY symbol""")
def q_a6(spark, base):
    a = _as_of(spark, base)
    return stats.depth_activity(fx.depth(spark, base, a - dt.timedelta(hours=24)), a)


@register("A7_live_tick_stats", f"""
    SELECT symbol, count(*) AS tick_count, max(price) AS max_price,
           arg_max(price, ("timestamp", id)) AS last_price, max("timestamp") AS last_update
    FROM ticks WHERE "timestamp" > {AS_OF} - INTERVAL 6 HOUR GROUP BY symbol""")
def q_a7(spark, base):
    return stats.live_tick_stats(fx.ticks(spark, base), _as_of(spark, base), "6 hours")


@register("A8_live_depth_levels", """
    SELECT symbol, count(DISTINCT level) AS distinct_levels, count(*) AS updates
    FROM depth WHERE "timestamp" > (SELECT max("timestamp") FROM depth) - INTERVAL 2 DAY
    GROUP BY symbol""")
def q_a8(spark, base):
    a = resolve_as_of(fx.depth(spark, base))
    return stats.live_depth_levels(fx.depth(spark, base, a and a - dt.timedelta(days=2)), a, "2 days")


@register("A11_status_counts", """
    SELECT count(*) AS total, count(*) FILTER (WHERE action = 'ADD') AS add_count,
           count(*) FILTER (WHERE action = 'MODIFY') AS modify_count,
           count(*) FILTER (WHERE action = 'DELETE') AS delete_count,
           count(*) FILTER (WHERE action = 'FILL') AS fill_count
    FROM order_updates""")
def q_a11(spark, base):
    return stats.status_counts(fx.order_updates(spark, base), "action",
                               ["ADD", "MODIFY", "DELETE", "FILL"])


@register("A12_freshness", f"""
    SELECT 'ticks' AS table_name, count(*) FILTER (WHERE "timestamp" > {AS_OF} - INTERVAL 5 MINUTE) > 0 AS healthy FROM ticks
    UNION ALL SELECT 'quotes', count(*) FILTER (WHERE "timestamp" > {AS_OF} - INTERVAL 5 MINUTE) > 0 FROM quotes
    UNION ALL SELECT 'depth', count(*) FILTER (WHERE "timestamp" > {AS_OF} - INTERVAL 5 MINUTE) > 0 FROM depth
    UNION ALL SELECT 'order_updates', count(*) FILTER (WHERE "timestamp" > {AS_OF} - INTERVAL 5 MINUTE) > 0 FROM order_updates""")
def q_a12(spark, base):
    return stats.freshness({"ticks": fx.ticks(spark, base), "quotes": fx.quotes(spark, base),
                            "depth": fx.depth(spark, base),
                            "order_updates": fx.order_updates(spark, base)},
                           _as_of(spark, base))


# ---------------------------------------------------------------- order flow

def _vp(spark, base):
    return flow.build_volume_profile(fx.ticks(spark, base), "1 hour")


@register("A13_volume_profile", "SELECT * FROM volume_profile")
def q_a13(spark, base):
    return _vp(spark, base)


@register("A13_profile_lineitem_part", """
    SELECT date_trunc('day', l_shipdate) AS "timestamp", p_brand AS symbol,
           CAST(floor(CAST(l_extendedprice AS DECIMAL(20,8)) / 1000) * 1000 AS DECIMAL(20,8)) AS price_level,
           CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS INTEGER) ELSE 0 END) AS BIGINT) AS buy_volume,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INTEGER) ELSE 0 END) AS BIGINT) AS sell_volume,
           CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS total_volume,
           count(*) FILTER (WHERE l_returnflag = 'A') AS buy_trades,
           count(*) FILTER (WHERE l_returnflag = 'R') AS sell_trades,
           CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS INTEGER) ELSE 0 END)
              - sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INTEGER) ELSE 0 END) AS BIGINT) AS delta,
           date_trunc('day', l_shipdate) AS period_start,
           date_trunc('day', l_shipdate) + INTERVAL 1 DAY AS period_end
    FROM lineitem JOIN part ON l_partkey = p_partkey
    GROUP BY 1, 2, 3""")
def q_a13_heavy(spark, base):
    """Join-heavy variant: lineitem joined with part, profiled by brand, day and 1000-wide price band."""
    return flow.build_volume_profile(fx.heavy_ticks(spark, base), "1 day", 1000)


@register("A9_volume_profile_summary", f"""
    SELECT symbol, price_level, CAST(sum(buy_volume) AS BIGINT) AS total_buy_volume,
           CAST(sum(sell_volume) AS BIGINT) AS total_sell_volume,
           CAST(sum(total_volume) AS BIGINT) AS total_volume,
           CAST(sum(buy_volume) - sum(sell_volume) AS BIGINT) AS total_delta
    FROM volume_profile WHERE "timestamp" > {AS_OF} - INTERVAL 1 DAY GROUP BY symbol, price_level""")
def q_a9(spark, base):
    return flow.volume_profile_summary(_vp(spark, base), _as_of(spark, base))


@register("A10_volume_profile_export", f"""
    SELECT symbol, price_level, CAST(sum(buy_volume) AS BIGINT) AS buy_vol,
           CAST(sum(sell_volume) AS BIGINT) AS sell_vol,
           CAST(sum(buy_volume - sell_volume) AS BIGINT) AS delta
    FROM volume_profile WHERE "timestamp" > {AS_OF} - INTERVAL 7 DAY GROUP BY symbol, price_level""")
def q_a10(spark, base):
    return flow.volume_profile_export(_vp(spark, base), 7, None, _as_of(spark, base))


_BARS_SQL = """
    SELECT time_bucket(INTERVAL {iv}, "timestamp") AS "timestamp", symbol,
           arg_min(price, ("timestamp", id)) AS open_price, max(price) AS high_price,
           min(price) AS low_price, arg_max(price, ("timestamp", id)) AS close_price,
           CAST(sum(size) AS BIGINT) AS volume, count(*) AS trade_count,
           CAST(sum(CASE WHEN aggressor_side = 'BUY' THEN size ELSE 0 END) AS BIGINT) AS buy_volume,
           CAST(sum(CASE WHEN aggressor_side = 'SELL' THEN size ELSE 0 END) AS BIGINT) AS sell_volume,
           CAST(sum(CASE WHEN aggressor_side = 'BUY' THEN size ELSE 0 END)
              - sum(CASE WHEN aggressor_side = 'SELL' THEN size ELSE 0 END) AS BIGINT) AS delta,
           {minutes} AS period_minutes
    FROM trades GROUP BY 1, 2"""


@register("A14_bars_1m", _BARS_SQL.format(iv="1 MINUTE", minutes=1))
def q_a14(spark, base):
    return flow.build_bars(fx.trades(spark, base), "1 minute")


@register("A15_bar_spread_1h", """
    SELECT time_bucket(INTERVAL 1 HOUR, "timestamp") AS "timestamp", symbol,
           round(CAST(sum(ask_price - bid_price) AS DOUBLE) / count(*), 6) AS avg_bid_ask_spread,
           count(*) AS quote_count
    FROM quotes WHERE ask_price - bid_price IS NOT NULL GROUP BY 1, 2""")
def q_a15(spark, base):
    return flow.bar_spread(fx.quotes(spark, base), "1 hour")


@register("A16_bar_order_flow_1h", """
    SELECT time_bucket(INTERVAL 1 HOUR, "timestamp") AS "timestamp", symbol,
           CAST(sum(CASE WHEN aggressor_side = 'BUY' THEN size ELSE 0 END) AS BIGINT) AS buy_volume,
           CAST(sum(CASE WHEN aggressor_side = 'SELL' THEN size ELSE 0 END) AS BIGINT) AS sell_volume,
           CAST(sum(CASE WHEN aggressor_side = 'BUY' THEN size ELSE 0 END)
              - sum(CASE WHEN aggressor_side = 'SELL' THEN size ELSE 0 END) AS BIGINT) AS delta
    FROM trades GROUP BY 1, 2""")
def q_a16(spark, base):
    return flow.bar_order_flow(fx.trades(spark, base), "1 hour")


_BAR_DEPTH_SQL = """
    bar_depth AS (
        SELECT time_bucket(INTERVAL 1 DAY, "timestamp") AS "timestamp", symbol,
               arg_max(bid, snap) AS total_bid_depth, arg_max(ask, snap) AS total_ask_depth
        FROM (SELECT symbol, "timestamp", "timestamp" AS snap,
                     CAST(sum(CASE WHEN side = 'B' THEN size ELSE 0 END) AS BIGINT) AS bid,
                     CAST(sum(CASE WHEN side = 'S' THEN size ELSE 0 END) AS BIGINT) AS ask
              FROM depth GROUP BY symbol, "timestamp") s
        GROUP BY 1, 2)"""


@register("A17_bar_depth_1d", f"WITH {_BAR_DEPTH_SQL} SELECT * FROM bar_depth")
def q_a17(spark, base):
    return flow.bar_depth(fx.depth(spark, base), "1 day")


@register("A14_market_stats_1d", f"""
    WITH bars AS ({_BARS_SQL.format(iv="1 DAY", minutes=1440)}),
    spread AS (
        SELECT time_bucket(INTERVAL 1 DAY, "timestamp") AS "timestamp", symbol,
               round(CAST(sum(ask_price - bid_price) AS DOUBLE) / count(*), 6) AS avg_bid_ask_spread
        FROM quotes WHERE ask_price - bid_price IS NOT NULL GROUP BY 1, 2),
    {_BAR_DEPTH_SQL}
    SELECT b.*, s.avg_bid_ask_spread, d.total_bid_depth, d.total_ask_depth
    FROM bars b LEFT JOIN spread s USING (symbol, "timestamp")
    LEFT JOIN bar_depth d USING (symbol, "timestamp")""")
def q_market_stats(spark, base):
    return flow.market_stats(fx.trades(spark, base), fx.quotes(spark, base),
                             fx.depth(spark, base), "1 day")


@register("A19_order_state", """
    SELECT order_id, count(*) AS updates, arg_max(action, ("timestamp", seq, price)) AS last_action,
           CAST(coalesce(sum(fill_size), 0) AS BIGINT) AS filled_size,
           arg_max(remaining_size, ("timestamp", seq, price)) AS remaining_size,
           max("timestamp") AS last_update
    FROM order_updates GROUP BY order_id""")
def q_a19(spark, base):
    return flow.order_state(fx.order_updates(spark, base))


@register("W6_running_delta", """
    SELECT id, "timestamp", symbol,
           CAST(CASE WHEN aggressor_side = 'BUY' THEN size ELSE 0 END
              - CASE WHEN aggressor_side = 'SELL' THEN size ELSE 0 END AS BIGINT) AS signed_volume,
           CAST(sum(CASE WHEN aggressor_side = 'BUY' THEN size ELSE 0 END
                  - CASE WHEN aggressor_side = 'SELL' THEN size ELSE 0 END)
                OVER (PARTITION BY symbol ORDER BY "timestamp", id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_delta
    FROM ticks""")
def q_w6(spark, base):
    return flow.running_delta(fx.ticks(spark, base))


@register("J7_asof_quotes", """
    SELECT t.id, t."timestamp", t.symbol, t.exchange, t.price, t.size, t.aggressor_side, t.trade_id,
           q."timestamp" AS quote_timestamp, q.bid_price, q.ask_price, q.bid_size, q.ask_size
    FROM trades t ASOF LEFT JOIN quotes q
      ON t.symbol = q.symbol AND t."timestamp" >= q."timestamp" """)
def q_j7(spark, base):
    return flow.asof_quotes(fx.trades(spark, base), fx.quotes(spark, base))


# ---------------------------------------------------------------- depth state

@register("W1_latest_depth", """
    SELECT DISTINCT ON (symbol, side, level) symbol, side, level, price, size, order_count,
           "timestamp", id
    FROM depth ORDER BY symbol, side, level, "timestamp" DESC, id DESC""")
def q_w1(spark, base):
    return dp.latest_depth(fx.depth(spark, base))


@register("J3_latest_snapshot", """
    SELECT * FROM depth d
    WHERE "timestamp" = (SELECT max("timestamp") FROM depth x WHERE x.symbol = d.symbol)""")
def q_j3(spark, base):
    return dp.latest_snapshot(fx.depth(spark, base))


@register("W5_depth_ttl_1d", """
    SELECT d.* FROM depth d JOIN (SELECT symbol, max("timestamp") AS m FROM depth GROUP BY symbol) x
      USING (symbol)
    WHERE d."timestamp" >= x.m - INTERVAL 1 DAY""")
def q_w5(spark, base):
    return dp.depth_ttl(fx.depth(spark, base), "1 day")


@register("N8_long_wide_roundtrip", """
    SELECT symbol, "timestamp", side, level, price, size, order_count, id FROM depth""")
def q_n8(spark, base):
    rt = dp.wide_to_long(dp.long_to_wide(fx.depth(spark, base), ("symbol", "timestamp", "msg_id")), ("symbol", "timestamp", "msg_id"))
    return rt.select("symbol", "timestamp", "side", "level", "price", "size", "order_count", "id")


@register("N7_long_to_wide", """
    SELECT symbol, "timestamp", msg_id, count(*) FILTER (WHERE side = 'B') AS n_bids,
           count(*) FILTER (WHERE side = 'S') AS n_asks, CAST(count(*) AS INTEGER) AS depth,
           min(level) FILTER (WHERE side = 'B') AS first_bid_level
    FROM depth GROUP BY symbol, "timestamp", msg_id""")
def q_n7(spark, base):
    w = dp.long_to_wide(fx.depth(spark, base), ("symbol", "timestamp", "msg_id"))
    return w.select("symbol", "timestamp", "msg_id", F.size("bids").cast("bigint").alias("n_bids"),
                    F.size("asks").cast("bigint").alias("n_asks"), "depth",
                    F.get("bids", 0)["level"].alias("first_bid_level"))


# ---------------------------------------------------------------- symbols and joins

@register("J1_symbol_listing", """
    SELECT s.symbol, s.exchange, s.active, count(t.id) AS tick_count, max(t."timestamp") AS last_tick
    FROM symbols s LEFT JOIN ticks t ON t.symbol = s.symbol
    GROUP BY s.symbol, s.exchange, s.active""")
def q_j1(spark, base):
    return joins.symbol_listing(fx.symbols(spark), fx.ticks(spark, base))


@register("J2_symbol_directory", f"""
    WITH ta AS (
        SELECT symbol, arg_max(exchange, (last_update, exchange)) AS exchange,
               CAST(sum(tick_count) AS BIGINT) AS tick_count, max(last_update) AS last_tick_update
        FROM (SELECT symbol, exchange, count(*) AS tick_count, max("timestamp") AS last_update
              FROM ticks WHERE "timestamp" > {AS_OF} - INTERVAL 24 HOUR GROUP BY 1, 2) x
        GROUP BY symbol),
    da AS (SELECT symbol, count(*) AS level2_count, max("timestamp") AS last_level2_update
           FROM depth WHERE "timestamp" > {AS_OF} - INTERVAL 24 HOUR GROUP BY symbol)
    SELECT coalesce(ta.symbol, da.symbol) AS symbol, coalesce(ta.exchange, 'Unknown') AS exchange,
           coalesce(ta.tick_count, 0) AS tick_count, ta.last_tick_update,
           coalesce(da.level2_count, 0) AS level2_count, da.last_level2_update
    FROM ta FULL OUTER JOIN da ON ta.symbol = da.symbol""")
def q_j2(spark, base):
    a = _as_of(spark, base)
    return joins.symbol_directory(fx.ticks(spark, base), fx.depth(spark, base, a - dt.timedelta(hours=24)), a)


@register("J4_upsert_symbols", f"""
    WITH req AS (
        SELECT symbol, exchange FROM requests
        UNION ALL
        SELECT lower(r.root) || 'z' || c_custkey, r.exchange
        FROM customer JOIN (VALUES (0, 'GC', 'COMEX'), (1, 'CL', 'NYMEX'), (2, 'MGC', 'COMEX'), (3, 'RTY', 'CME'),
                                   (4, 'GLD', 'COMEX'), (5, 'YM', 'CBOT'), (6, 'QQ', 'CME')) r(n, root, exchange)
          ON c_custkey % 7 = r.n),
    inc AS (SELECT upper(trim(symbol)) AS symbol, min(exchange) AS in_exchange FROM req GROUP BY 1),
    merged AS (
        SELECT s.id, coalesce(s.symbol, i.symbol) AS symbol,
               coalesce(s.exchange, i.in_exchange, 'CME') AS exchange, s.description,
               CASE WHEN i.symbol IS NOT NULL THEN true ELSE s.active END AS active,
               CASE WHEN s.id IS NULL THEN {AS_OF} ELSE s.created_at END AS created_at,
               CASE WHEN i.symbol IS NOT NULL THEN {AS_OF} ELSE s.updated_at END AS updated_at
        FROM symbols s FULL OUTER JOIN inc i ON s.symbol = i.symbol)
    SELECT coalesce(id, (SELECT max(id) FROM symbols)
                    + row_number() OVER (PARTITION BY id IS NULL ORDER BY symbol)) AS id,
           symbol, exchange, description, active, created_at, updated_at
    FROM merged""")
def q_j4(spark, base):
    """Requests for every traded symbol (existing rows: re-activated, touched)
    plus one new contract per customer key (inserted with the next ids)."""
    roots = F.array(*[F.lit(r) for r in ("gc", "cl", "mgc", "rty", "gld", "ym", "qq")])
    key = F.col("c_custkey")
    new = fx.read_table(spark, base, "customer").select(
        F.concat(F.element_at(roots, (key % 7 + 1).cast("int")), F.lit("z"), key.cast("string")).alias("symbol"))
    new = new.withColumn("exchange", exchange_for(F.upper("symbol")))
    incoming = fx.requests(spark, base).unionByName(new)
    return joins.upsert_symbols(fx.symbols(spark), incoming, _as_of(spark, base))


@register("J5_insert_missing", "SELECT * FROM ticks")
def q_j5(spark, base):
    t = fx.ticks(spark, base)
    current = fl.recent(t, "15 days", _as_of(spark, base))
    return joins.insert_missing(current, t, ["id"])


_ROOTS = ("GC MGC GLD CL NG RB HO ES NQ YM RTY 6A 6B 6C 6E 6J 6S ZC ZS ZW ZL ZM SI HG PA PL "
          "QQ MG Z 6 ESX SIL").split()


@register("J6_exchange_by_prefix", f"""
    SELECT id, sym AS symbol, {exchange_case('sym')} AS exchange
    FROM (SELECT event_id AS id, ({_ROOTS!r})[event_id % {len(_ROOTS)} + 1] || 'Z' || CAST(year(ts) % 10 AS VARCHAR) AS sym
          FROM events) e""")
def q_j6(spark, base):
    """Every event mapped onto a contract symbol: all roots of the table and some that are in none."""
    ev = fx.read_table(spark, base, "events")
    root = F.element_at(F.array(*map(F.lit, _ROOTS)), (F.col("event_id") % len(_ROOTS) + 1).cast("int"))
    sym = F.concat(root, F.lit("Z"), (F.year("ts") % 10).cast("string"))
    return with_exchange(ev.select(F.col("event_id").alias("id"), sym.alias("symbol")))


@register("J8_subscribed_only", """
    SELECT t.* FROM ticks t
    WHERE EXISTS (SELECT 1 FROM symbols s WHERE s.active AND s.symbol = t.symbol AND s.exchange = t.exchange)""")
def q_j8(spark, base):
    subs = fx.symbols(spark).filter("active")
    return joins.subscribed_only(fx.ticks(spark, base), subs)


@register("U2_dedup_requests", "SELECT DISTINCT symbol, exchange FROM requests")
def q_u2(spark, base):
    return fx.requests(spark, base).dropDuplicates(["symbol", "exchange"])


# ---------------------------------------------------------------- normalisation

@register("N1_v1_library_ticks", """
    SELECT "timestamp", symbol, CAST(price AS DOUBLE) AS price, size AS volume,
           CASE WHEN aggressor_side = 'BUY' THEN 'buy' ELSE 'sell' END AS direction,
           '' AS trade_type, exchange
    FROM trades""")
def q_n1(spark, base):
    t = fx.trades(spark, base)
    raw = t.select("timestamp", "symbol", "exchange",
                   F.col("price").cast("double").alias("last_trade_price"),
                   F.col("size").alias("last_trade_size"),
                   F.when(F.col("aggressor_side") == "BUY", 1)
                    .when(F.col("aggressor_side") == "SELL", 2).alias("aggressor_side"))
    return nz.normalize_ticks_v1(raw, arrival="timestamp")


@register("N9_v1_ticks", """
    SELECT id, "timestamp", symbol, CAST(price AS DOUBLE) AS price, size AS volume,
           coalesce(lower(aggressor_side), 'sell') AS direction, CAST(NULL AS VARCHAR) AS trade_type,
           exchange
    FROM ticks""")
def q_n9(spark, base):
    return nz.to_v1_ticks(fx.ticks(spark, base))


@register("N10_signed_volume", """
    SELECT *, CASE WHEN aggressor_side = 'BUY' THEN size ELSE 0 END AS buy_volume,
              CASE WHEN aggressor_side = 'SELL' THEN size ELSE 0 END AS sell_volume
    FROM ticks""")
def q_n10(spark, base):
    return nz.with_signed_volume(fx.ticks(spark, base))


@register("N11_shape_rows", """
    SELECT id, strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp", symbol, exchange,
           CAST(price AS DOUBLE) AS price, size, aggressor_side, trade_id
    FROM ticks""")
def q_n11(spark, base):
    return nz.shape_rows(fx.ticks(spark, base))


@register("N13_parse_symbols", """
    SELECT upper(event_type) AS symbol, CASE event_type WHEN 'view' THEN 'NYMEX' WHEN 'purchase' THEN 'COMEX'
           WHEN 'signup' THEN 'CBOT' ELSE 'CME' END AS exchange FROM events
    UNION ALL SELECT upper(event_type), 'CME' FROM events""")
def q_n13(spark, base):
    t = fx.ticks(spark, base)
    text = F.concat(F.lit(" "), F.lower("symbol"), F.lit(":"), F.col("exchange"), F.lit(" , ,"),
                    F.lower("symbol"), F.lit(" "))
    return nz.parse_symbols(t.select(text.alias("symbols")), "symbols")


@register("N12_enforce_depth", """
    SELECT id, "timestamp", symbol, exchange, side, level, price, size, order_count, msg_id, 0 AS implied_size
    FROM depth""")
def q_n12(spark, base):
    from ..schemas import enforce
    d = fx.depth(spark, base).withColumn("implied_size", F.lit(None).cast("int"))
    ok, _ = enforce(d, "depth")
    return ok


# ---------------------------------------------------------------- quality and alerts

@register("W4_data_gaps_1h", """
    SELECT symbol, gap_start, gap_end, round(date_diff('microsecond', gap_start, gap_end) / 1e6, 6) AS gap_seconds
    FROM (SELECT symbol, lag("timestamp") OVER (PARTITION BY symbol ORDER BY "timestamp", id) AS gap_start,
                 "timestamp" AS gap_end FROM ticks) x
    WHERE date_diff('microsecond', gap_start, gap_end) > 3600000000""")
def q_w4(spark, base):
    return quality.data_gaps(fx.ticks(spark, base), "1 hour")


_M1_RULES = quality.rules_with(recent_ticks=4.0)


@register("M1_evaluate_rules", """
    SELECT entity, ts, 'low_data_activity' AS alert_type, 'warning' AS severity,
           'recent_ticks' AS metric, value
    FROM metrics WHERE value < 4""")
def q_m1(spark, base):
    return quality.evaluate_rules(fx.metrics(spark, base), _M1_RULES)


@register("M2_suppress_3h", """
    WITH RECURSIVE a AS (
        SELECT entity, 'low_data_activity' AS alert_type, ts,
               row_number() OVER (PARTITION BY entity ORDER BY ts) AS rn
        FROM metrics WHERE value < 4),
    r AS (
        SELECT entity, alert_type, ts, rn, ts AS last_fired, true AS fired FROM a WHERE rn = 1
        UNION ALL
        SELECT a.entity, a.alert_type, a.ts, a.rn,
               CASE WHEN date_diff('microsecond', r.last_fired, a.ts) >= 10800000000 THEN a.ts ELSE r.last_fired END,
               date_diff('microsecond', r.last_fired, a.ts) >= 10800000000
        FROM r JOIN a ON a.entity = r.entity AND a.alert_type = r.alert_type AND a.rn = r.rn + 1)
    SELECT entity, ts, alert_type, 'warning' AS severity, 'recent_ticks' AS metric, m.value
    FROM r JOIN metrics m USING (entity, ts) WHERE r.fired""")
def q_m2(spark, base):
    alerts = quality.evaluate_rules(fx.metrics(spark, base), _M1_RULES)
    return quality.suppress(alerts, "3 hours")


@register("M3_low_activity", """
    SELECT symbol AS entity, time_bucket(INTERVAL 1 HOUR, "timestamp") AS ts,
           'low_data_activity' AS alert_type, 'warning' AS severity, count(*) AS tick_count
    FROM ticks GROUP BY 1, 2 HAVING count(*) < 4""")
def q_m3(spark, base):
    return quality.low_activity(fx.ticks(spark, base), 4, "1 hour")


# Money columns of each query's result. Both sides return them as DOUBLE (an
# exact conversion of the same DECIMAL value), so results compare equal however
# a checker turns them into Python values (DuckDB's pandas path yields floats,
# Spark's yields Decimal objects). The operators themselves keep DECIMAL(20,8).
MONEY_COLUMNS = {
    'S1_scan_ticks': ('price',),
    'F5_select_range': ('price',),
    'O3_console_ticks': ('price', 'bid_price', 'ask_price'),
    'A7_live_tick_stats': ('max_price', 'last_price'),
    'A13_volume_profile': ('price_level',),
    'A13_profile_lineitem_part': ('price_level',),
    'A9_volume_profile_summary': ('price_level',),
    'A10_volume_profile_export': ('price_level',),
    'A14_bars_1m': ('open_price', 'high_price', 'low_price', 'close_price'),
    'A14_market_stats_1d': ('open_price', 'high_price', 'low_price', 'close_price'),
    'J7_asof_quotes': ('price', 'bid_price', 'ask_price'),
    'W1_latest_depth': ('price',),
    'J3_latest_snapshot': ('price',),
    'W5_depth_ttl_1d': ('price',),
    'N8_long_wide_roundtrip': ('price',),
    'J5_insert_missing': ('price',),
    'J8_subscribed_only': ('price',),
    'N10_signed_volume': ('price',),
    'N12_enforce_depth': ('price',),
    'S4_N2_feed_ticks': ('price', 'bid_price', 'ask_price'),
    'N4_feed_quotes': ('bid_price', 'ask_price'),
    'N6_feed_long_depth': ('price',),
    'S5_N3_binary_ticks': ('price',),
    'S5_capture_ticks': ('price',),
    'E1_export_ticks_csv': ('price',),
    'E2_export_depth_csv': ('price',),
    'E3_export_profile_csv': ('price_level',),
    'E5_archive': ('price',),
    'E5_archive_table': ('price',),
    'E6_restore_twice': ('price',),
    'E7_purge': ('price',),
    'E7_purge_table': ('price',),
    'T1_ingest': ('price',),
    'T2_bounded_ingest': ('price',),
    'T1_feed_ingest_ticks': ('price',),
    'T3_subscribed_stream': ('price',),
    'T4_live_stats_stream': ('max_price',),
    'T4_live_stats_sliding': ('max_price',),
    'T4_live_view': ('max_price',),
    'T1_feed_ingest_quotes': ('bid_price', 'ask_price'),
    'T1_feed_ingest_depth': ('price',),
    'S2_table_by_ddl': ('price',),
    'O1_newest_from_days': ('price',),
    'T9_replay_weeks_later': ('price',),
    'A14_bars_refreshed': ('open_price', 'high_price', 'low_price', 'close_price'),
    'A13_profile_refreshed': ('price_level',),
    'T6_bars_corrected': ('open_price', 'high_price', 'low_price', 'close_price'),
    'T6_profile_corrected': ('price_level',),
    'T5_book_stream': ('price',),
    'T6_bars_stream': ('open_price', 'high_price', 'low_price', 'close_price'),
    'T9_dedup_stream': ('price',),
    'T6_profile_stream': ('price_level',),
}


def _money_as_double(df: DataFrame) -> DataFrame:
    from pyspark.sql.types import DecimalType
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
                       else F.col(f.name) for f in df.schema.fields])


def _oracle_money_as_double(name: str, sql: str) -> str:
    cols = MONEY_COLUMNS.get(name)
    if not cols:
        return sql
    repl = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) AS q"


def queries() -> dict[str, QueryFn]:
    from . import catalog_io, catalog_stored  # noqa: F401  (register ingest, life-cycle, stream and layout queries)

    def wrap(fn: QueryFn) -> QueryFn:
        return lambda spark, base: _money_as_double(fn(spark, base))
    return {k: wrap(v[0]) for k, v in REGISTRY.items()}


def oracles() -> dict[str, str]:
    from . import catalog_io, catalog_stored  # noqa: F401
    return {k: _oracle_money_as_double(k, v[1]) for k, v in REGISTRY.items() if v[1] is not None}
