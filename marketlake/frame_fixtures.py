"""Binary frames built from the market views: inputs of the S5 queries, the bench and tests.

Frames are what a capture would hold, ``[u32 length][u16 type][body]``, encoded with built-in expressions and, for doubles, in
Arrow; the field readers are the inverse of the encoders, and check them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .sources.frames import BID_OFFER, LAST_TRADE

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _bytes(b: Column, pos: Column | int, n: int) -> Column:
    p = pos if isinstance(pos, Column) else F.lit(pos)
    return F.call_function("substring", b, p, F.lit(n))


def u_int(b: Column, pos: Column | int, n: int) -> Column:
    """Unsigned big-endian integer of ``n`` (<= 4) bytes at 1-based ``pos``."""
    return F.conv(F.hex(_bytes(b, pos, n)), 16, 10).cast("bigint")


def f64(b: Column, pos: Column | int) -> Column:
    """IEEE-754 big-endian double at 1-based ``pos``."""
    p = pos if isinstance(pos, Column) else F.lit(pos)
    return f64_from_words(u_int(b, p, 4), u_int(b, p + 4, 4))


def f64_from_words(hi: Column, lo: Column) -> Column:
    """IEEE-754 double from its high and low unsigned 32-bit words."""
    sign = F.when(hi >= F.lit(2 ** 31), F.lit(-1.0)).otherwise(F.lit(1.0))
    exp = F.shiftright(hi, 20).bitwiseAND(0x7FF)
    mant = hi.bitwiseAND(0xFFFFF) * F.lit(2 ** 32) + lo
    normal = (F.lit(1.0) + mant.cast("double") / F.lit(float(2 ** 52))) * F.pow(F.lit(2.0), exp - 1023)
    sub = mant.cast("double") * F.pow(F.lit(2.0), F.lit(-1074.0))
    inf_nan = F.when(mant == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    mag = F.when(exp == 0, sub).when(exp == 0x7FF, inf_nan).otherwise(normal)
    return F.when(hi.isNull() | lo.isNull(), F.lit(None).cast("double")).otherwise(sign * mag)


def _u_bytes(v: Column, n: int) -> Column:
    return F.unhex(F.lpad(F.hex(v.cast("bigint")), 2 * n, "0"))


def f64_bits(x: Column) -> Column:
    """IEEE-754 bit pattern of a double as a (signed) long, built-in only.

    The binary exponent comes from ``log2`` and is corrected by one step when
    rounding put it off; scaling by a power of two and removing the leading 1
    are exact, so the 52-bit mantissa is exact. Zero, subnormals, infinities
    and NaN are handled explicitly.
    """
    a = F.abs(x)
    scale = lambda v, k: F.try_divide(v, F.pow(F.lit(2.0), k))  # noqa: E731  (exact: power of two)
    finite = (a > 0.0) & (a < float("inf"))
    e0 = F.floor(F.when(finite, F.log2(a))).try_cast("int")
    e = (F.when(scale(a, e0) >= 2.0, e0 + 1)
          .when(scale(a, e0) < 1.0, e0 - 1).otherwise(e0))
    normal_m = ((scale(a, e) - F.lit(1.0)) * F.lit(float(2 ** 52))).try_cast("bigint")
    two_537 = F.pow(F.lit(2.0), F.lit(537.0))  # 2**1074 overflows a double; scale twice
    sub_m = F.when(a < 2.3e-308, a * two_537 * two_537).try_cast("bigint")
    magnitude = (F.when(a == 0.0, F.lit(0).cast("bigint"))
                  .when(F.isnan(x), F.lit(0x7FF8000000000000))
                  .when(a == float("inf"), F.lit(0x7FF0000000000000))
                  .when(e < -1022, sub_m)
                  .otherwise(F.shiftleft((e + 1023).cast("bigint"), 52) + normal_m))
    negative = (x < 0.0) | (x.cast("string") == "-0.0")
    return F.when(negative, magnitude + F.lit(-(2 ** 63))).otherwise(magnitude)


@F.arrow_udf(T.BinaryType())
def f64_bytes(x: pa.Array) -> pa.Array:
    """8 big-endian bytes of a double, as ``f64_bits`` defines them (that expression was measured at twenty
    microseconds a value). Every NaN is the same."""
    values = x.fill_null(0.0).to_numpy(zero_copy_only=False)
    data = np.where(np.isnan(values), np.nan, values).astype(">f8")
    made = pa.Array.from_buffers(pa.binary(8), len(x), [None, pa.py_buffer(data)])
    return pc.if_else(x.is_valid(), made.cast(pa.binary()), None)


def _frame(df: DataFrame, code: int) -> DataFrame:
    body = F.col("_body")
    return df.select("id", F.concat(_u_bytes(F.length(body) + 2, 4), _u_bytes(F.lit(code), 2),
                                    body).alias("frame"))


def encode_trade_frames(ticks: DataFrame) -> DataFrame:
    """LAST_TRADE frames (one per tick row): symbol, price, size, epoch ms."""
    sym = F.encode(F.col("symbol"), "UTF-8")
    ms = F.expr(f"timestampdiff(MILLISECOND, {_EPOCH}, `timestamp`)")
    body = F.concat(_u_bytes(F.length(sym), 4), sym, f64_bytes(F.col("price").cast("double")),
                    _u_bytes(F.col("size"), 4), _u_bytes(ms, 8))
    return _frame(ticks.select("id", body.alias("_body")), LAST_TRADE)


def encode_quote_frames(quotes: DataFrame) -> DataFrame:
    """BID_OFFER frames: symbol, bid, bid size, ask, ask size."""
    sym = F.encode(F.col("symbol"), "UTF-8")
    body = F.concat(_u_bytes(F.length(sym), 4), sym,
                    f64_bytes(F.col("bid_price").cast("double")), _u_bytes(F.col("bid_size"), 4),
                    f64_bytes(F.col("ask_price").cast("double")), _u_bytes(F.col("ask_size"), 4))
    return _frame(quotes.select("id", body.alias("_body")), BID_OFFER)


def encode_bare_frames(df: DataFrame, code: int) -> DataFrame:
    """Frames of a given type with an empty body (e.g. depth updates)."""
    return df.select("id", F.concat(_u_bytes(F.lit(2), 4), _u_bytes(F.lit(code), 2)).alias("frame"))
