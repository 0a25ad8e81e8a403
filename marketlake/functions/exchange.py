"""Symbol -> exchange by the first matching root prefix.

The root is the symbol without its trailing digits; the first prefix in the
declared order that the root starts with decides; no match means CME.
Compiled into one CASE expression (no join), so it runs inside whole-stage
codegen next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values (must equal the reference's prefix table, in its declared order).
PREFIX_EXCHANGE = [
    ("GC", "COMEX"), ("MGC", "COMEX"), ("GLD", "COMEX"),
    ("CL", "NYMEX"), ("NG", "NYMEX"), ("RB", "NYMEX"), ("HO", "NYMEX"),
    ("ES", "CME"), ("NQ", "CME"), ("YM", "CBOT"), ("RTY", "CME"),
    ("6A", "CME"), ("6B", "CME"), ("6C", "CME"), ("6E", "CME"), ("6J", "CME"), ("6S", "CME"),
    ("ZC", "CBOT"), ("ZS", "CBOT"), ("ZW", "CBOT"), ("ZL", "CBOT"), ("ZM", "CBOT"),
    ("SI", "COMEX"), ("HG", "COMEX"), ("PA", "NYMEX"), ("PL", "NYMEX"),
]
DEFAULT_EXCHANGE = "CME"


def symbol_root(symbol: Column | str) -> Column:
    s = F.col(symbol) if isinstance(symbol, str) else symbol
    return F.regexp_replace(s, "[0-9]+$", "")


def exchange_for(symbol: Column | str, prefix_map=None, default: str = DEFAULT_EXCHANGE) -> Column:
    root = symbol_root(symbol)
    expr = None
    for prefix, exchange in (prefix_map or PREFIX_EXCHANGE):
        cond = root.startswith(prefix)
        expr = F.when(cond, exchange) if expr is None else expr.when(cond, exchange)
    return F.lit(default) if expr is None else expr.otherwise(default)


def with_exchange(df: DataFrame, symbol_col: str = "symbol", out: str = "exchange",
                  prefix_map=None, default: str = DEFAULT_EXCHANGE) -> DataFrame:
    """J6 on a frame: the symbol root is computed once per row in its own
    projection (it is referenced by every CASE arm, and CASE conditions do not
    share sub-expressions), then the first matching prefix decides."""
    rooted = df.withColumn("_xch_root", symbol_root(symbol_col))
    expr = None
    for prefix, exchange in (prefix_map or PREFIX_EXCHANGE):
        cond = F.col("_xch_root").startswith(prefix)
        expr = F.when(cond, exchange) if expr is None else expr.when(cond, exchange)
    return rooted.withColumn(out, expr.otherwise(default) if expr is not None else F.lit(default)).drop("_xch_root")
