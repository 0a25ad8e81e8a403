"""Newline-delimited JSON feed - parse with an explicit schema, keep
bad lines as rejects, route by message type.

Works the same on ``spark.read.text`` (batch) and ``spark.readStream.text``
(stream): parsing and routing are projections and filters, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

LEVEL = T.StructType([
    T.StructField("price", T.DoubleType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("num_orders", T.IntegerType()),
    T.StructField("order_count", T.IntegerType()),
])

CORRUPT = "_corrupt_record"

#: Numbers arrive as JSON numbers or as text; they are read as text and typed here.
NUMBERS = {"price": "double", "size": "int", "bid_price": "double", "ask_price": "double", "bid_size": "int",
           "ask_size": "int"}
PRICE_LIMIT = 1e12      # decimal(20,8) has twelve digits before the point
INT_LIMIT = 2 ** 31

MESSAGE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("exchange", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("bid_price", T.StringType()),
    T.StructField("ask_price", T.StringType()),
    T.StructField("bid_size", T.StringType()),
    T.StructField("ask_size", T.StringType()),
    T.StructField("aggressor_side", T.StringType()),
    T.StructField("trade_id", T.StringType()),
    T.StructField("update_type", T.StringType()),
    T.StructField("bids", T.ArrayType(LEVEL)),
    T.StructField("asks", T.ArrayType(LEVEL)),
    T.StructField(CORRUPT, T.StringType()),
])

# Fixed values of the reference: message type -> handler.
ROUTES = {
    "TICK": "tick", "TRADE": "tick",
    "QUOTE": "quote", "BBO": "quote",
    "DEPTH": "depth", "LEVEL2": "depth",
    "STATUS": "log", "ERROR": "log",
}


def _number(text, kind: str):
    """A number of the given kind from its text; NULL if it is none or out of range."""
    value = text.try_cast("double")
    limit = PRICE_LIMIT if kind == "double" else float(INT_LIMIT)
    return F.when(~F.isnan(value) & (F.abs(value) < limit), value.try_cast(kind))


def parse_tagged(lines: DataFrame, col: str = "value") -> DataFrame:
    """S3 in one projection: (_line, m, _reason, _bad) per non-blank line. Persist this
    frame when both messages and rejects are consumed, so each line is parsed once."""
    text = F.trim(F.col(col))
    # The parsed message leaves through a one-element ``inline``: filters on it
    # (reject split, routing) cannot be pushed beneath a generator, so each
    # line is parsed once instead of once more inside every pushed filter.
    parsed = lines.filter(text != "").select(F.inline(F.array(F.struct(
        F.col(col).alias("_line"),
        F.from_json(F.col(col), MESSAGE, {"mode": "PERMISSIVE",
                                          "columnNameOfCorruptRecord": CORRUPT}).alias("m")))))
    corrupt = F.col("m").isNull() | F.col(f"m.{CORRUPT}").isNotNull()
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("_line")).startswith("OBJECT"), F.lit(False))
    reason = F.when(corrupt & is_object, "bad field").when(corrupt, "invalid JSON")
    for name, kind in NUMBERS.items():
        field = F.col(f"m.{name}")
        reason = reason.when(field.isNotNull() & _number(field, kind).isNull(), f"bad field: {name}")
    typed = F.struct(*[(_number(F.col(f"m.{f.name}"), NUMBERS[f.name]) if f.name in NUMBERS else F.col(f"m.{f.name}"))
                       .alias(f.name) for f in MESSAGE.fields])
    return parsed.select("_line", typed.alias("m"), reason.alias("_reason")).withColumn(
        "_bad", F.col("_reason").isNotNull())


def split_tagged(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = parsed.filter(~F.col("_bad")).select("m.*").drop(CORRUPT)
    rejects = parsed.filter(F.col("_bad")).select(F.col("_line").alias("line"),
                                                  F.col("_reason").alias("reject_reason"))
    return good, rejects


def parse_lines(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """S3: text lines -> (messages, rejects). A line that is not a JSON object, or
    has a field that is no number of its range, is a reject (kept with its text and
    the reason, never silently dropped); quoted numbers and whole numbers with a
    point are read; blank lines are skipped as the reference does."""
    return split_tagged(parse_tagged(lines, col))


def read_json_feed(spark: SparkSession, path: str, streaming: bool = False,
                   **options) -> tuple[DataFrame, DataFrame]:
    """S3 over files: one message per line (text source, batch or stream)."""
    reader = spark.readStream if streaming else spark.read
    lines = reader.options(**options).text(path)
    return parse_lines(lines)


def route_class(type_col: str = "type"):
    t = F.upper(F.coalesce(F.col(type_col), F.lit("")))
    expr = None
    for name, cls in ROUTES.items():
        expr = F.when(t == name, cls) if expr is None else expr.when(t == name, cls)
    return expr.otherwise("unknown")


def route(messages: DataFrame) -> dict[str, DataFrame]:
    """One DataFrame per handler class: tick, quote, depth, log, unknown."""
    tagged = messages.withColumn("_route", route_class())
    return {cls: tagged.filter(F.col("_route") == cls).drop("_route")
            for cls in ("tick", "quote", "depth", "log", "unknown")}


def route_counts(messages: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """Messages per route (and invalid lines), one aggregate."""
    out = messages.groupBy(route_class().alias("route")).agg(F.count(F.lit(1)).alias("messages"))
    if rejects is not None:
        out = out.unionByName(rejects.agg(F.count(F.lit(1)).alias("messages"))
                              .select(F.lit("invalid").alias("route"), "messages"))
    return out
