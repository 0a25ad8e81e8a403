"""The fixture views of ``marketlake.fixtures`` as DuckDB SQL (oracle side)."""

from __future__ import annotations

from ..fixtures import SYMBOL_ROWS

_EXCH = ("CASE event_type WHEN 'view' THEN 'NYMEX' WHEN 'purchase' THEN 'COMEX' "
         "WHEN 'signup' THEN 'CBOT' ELSE 'CME' END")
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def exchange_case(symbol: str) -> str:
    """The exchange of a contract root, spelled out (the root is the symbol without trailing digits)."""
    root = f"regexp_replace({symbol}, '[0-9]+$', '')"
    return (f"CASE WHEN regexp_matches({root}, '^(GC|MGC|GLD|SI|HG)') THEN 'COMEX' "
            f"WHEN regexp_matches({root}, '^(CL|NG|RB|HO|PA|PL)') THEN 'NYMEX' "
            f"WHEN regexp_matches({root}, '^(YM|ZC|ZS|ZW|ZL|ZM)') THEN 'CBOT' ELSE 'CME' END")


def _symbols_sql() -> str:
    rows = ", ".join(f"({i}::BIGINT, '{s}', '{e}', '{d}', {str(a).lower()})"
                     for i, s, e, d, a in SYMBOL_ROWS)
    return ("SELECT id, symbol, exchange, description, active, "
            "TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at "
            f"FROM (VALUES {rows}) v(id, symbol, exchange, description, active)")


VIEWS = [
    ("ticks", f"""
        SELECT event_id AS id, ts AS "timestamp", upper(event_type) AS symbol, {_EXCH} AS exchange,
               CAST(value AS DECIMAL(20,8)) AS price, {_K} AS size,
               CASE user_id % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' END AS aggressor_side,
               CAST(event_id AS VARCHAR) AS trade_id
        FROM events"""),
    ("trades", "SELECT * FROM ticks"),
    ("quotes", """
        SELECT id, "timestamp" + (id % 300) * INTERVAL 1 SECOND AS "timestamp", symbol, exchange,
               CAST(price - 0.25 AS DECIMAL(20,8)) AS bid_price,
               CAST(price + 0.25 AS DECIMAL(20,8)) AS ask_price,
               size AS bid_size, size + 1 AS ask_size
        FROM ticks"""),
    ("depth", f"""
        SELECT event_id AS id, date_trunc('day', ts) AS "timestamp", upper(event_type) AS symbol,
               {_EXCH} AS exchange,
               CASE WHEN CAST(floor(user_id / 10) AS BIGINT) % 2 = 0 THEN 'B' ELSE 'S' END AS side,
               CAST(user_id % 10 + 1 AS INTEGER) AS level,
               CAST(value AS DECIMAL(20,8)) AS price, {_K} AS size,
               {_K} % 7 + 1 AS order_count, event_id // 20 AS msg_id
        FROM events"""),
    ("symbols", _symbols_sql()),
    ("order_updates", """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber AS seq, l_shipdate AS "timestamp",
               CAST(l_orderkey AS VARCHAR) AS order_id,
               CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'B' END AS side,
               CAST(l_extendedprice AS DECIMAL(20,8)) AS price, CAST(l_quantity AS INTEGER) AS size,
               CASE WHEN l_linestatus = 'F' THEN 'FILL' ELSE 'MODIFY' END AS action,
               CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS INTEGER) END AS fill_size,
               CASE WHEN l_linestatus = 'F' THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS remaining_size
        FROM lineitem"""),
    ("metrics", """
        SELECT symbol AS entity, date_trunc('hour', "timestamp") AS ts, 'recent_ticks' AS metric,
               CAST(count(*) AS DOUBLE) AS value
        FROM ticks GROUP BY 1, 2"""),
    ("requests", """
        SELECT DISTINCT symbol, exchange FROM ticks
        UNION ALL SELECT DISTINCT symbol, exchange FROM ticks WHERE symbol = 'CLICK'"""),
    ("volume_profile", """
        SELECT time_bucket(INTERVAL 1 HOUR, "timestamp") AS "timestamp", symbol,
               CAST(floor(price) AS DECIMAL(20,8)) AS price_level,
               CAST(sum(CASE WHEN aggressor_side = 'BUY' THEN size ELSE 0 END) AS BIGINT) AS buy_volume,
               CAST(sum(CASE WHEN aggressor_side = 'SELL' THEN size ELSE 0 END) AS BIGINT) AS sell_volume,
               CAST(sum(size) AS BIGINT) AS total_volume,
               count(*) FILTER (WHERE aggressor_side = 'BUY') AS buy_trades,
               count(*) FILTER (WHERE aggressor_side = 'SELL') AS sell_trades,
               CAST(sum(CASE WHEN aggressor_side = 'BUY' THEN size ELSE 0 END)
                  - sum(CASE WHEN aggressor_side = 'SELL' THEN size ELSE 0 END) AS BIGINT) AS delta,
               time_bucket(INTERVAL 1 HOUR, "timestamp") AS period_start,
               time_bucket(INTERVAL 1 HOUR, "timestamp") + INTERVAL 1 HOUR AS period_end
        FROM ticks GROUP BY 1, 2, 3"""),
]

AS_OF = '(SELECT max("timestamp") FROM ticks)'


def with_views(sql: str) -> str:
    """Prefix ``sql`` with every fixture view as a CTE."""
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in VIEWS)
    head = sql.lstrip()
    for kw in ("WITH RECURSIVE ", "WITH "):
        if head.upper().startswith(kw):
            return f"{kw}{ctes},\n{head[len(kw):]}"
    return f"WITH {ctes}\n{sql}"
