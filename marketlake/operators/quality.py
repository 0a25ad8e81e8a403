"""Data quality and alerting: W4 gaps, M1 threshold rules, M2 cool-down,
M3 low activity.

Rules are a literal array column, so evaluating them is a projection plus an
``inline`` (no join, no cross product). Metric snapshots are folded into one
map per (entity, ts) so a rule can see a metric as missing and use its default.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sequence import last_non_null, previous_row
from ..functions.timefn import interval_micros, micros_between
from ..session import checkpoint_dir


def data_gaps(ticks: DataFrame, threshold: str = "300 seconds",
              keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Consecutive ticks of a symbol further apart than ``threshold``."""
    prev = previous_row(ticks.select(*keys, "timestamp", "id"), list(keys), ["timestamp", "id"],
                        ["timestamp"])
    gap = micros_between("prev_timestamp", "timestamp")
    return (prev.withColumn("gap_us", gap)
                .filter(F.col("gap_us") > F.lit(interval_micros(threshold)))
                .select(*keys, F.col("prev_timestamp").alias("gap_start"),
                        F.col("timestamp").alias("gap_end"),
                        F.round(F.col("gap_us") / F.lit(1e6), 6).alias("gap_seconds")))


@dataclass(frozen=True)
class Rule:
    metric: str
    op: str             # one of > >= < <= = !=
    threshold: float
    alert_type: str
    severity: str
    default: float      # value used when the snapshot lacks the metric


# Fixed values of the reference's monitor: thresholds, alert types and
# severities; a missing number counts as 0, a missing health flag as healthy (1).
DEFAULT_RULES = (
    Rule("cpu_usage", ">", 90.0, "high_cpu_usage", "warning", 0.0),
    Rule("memory_usage", ">", 90.0, "high_memory_usage", "warning", 0.0),
    Rule("disk_usage", ">", 85.0, "high_disk_usage", "warning", 0.0),
    Rule("database_healthy", "=", 0.0, "database_connection_failed", "critical", 1.0),
    Rule("redis_healthy", "=", 0.0, "redis_connection_failed", "critical", 1.0),
    Rule("api_healthy", "=", 0.0, "api_health_failed", "critical", 1.0),
    Rule("recent_ticks", "<", 100.0, "low_data_activity", "warning", 0.0),
)


def rules_with(**thresholds: float) -> tuple[Rule, ...]:
    """Default rules with some thresholds replaced, keyed by metric name."""
    return tuple(Rule(r.metric, r.op, thresholds.get(r.metric, r.threshold), r.alert_type,
                      r.severity, r.default) for r in DEFAULT_RULES)


def _compare(op: Column, v: Column, t: Column) -> Column:
    return (F.when(op == ">", v > t).when(op == ">=", v >= t).when(op == "<", v < t)
             .when(op == "<=", v <= t).when(op == "=", v == t).when(op == "!=", v != t)
             .otherwise(F.lit(False)))


def evaluate_rules(metrics: DataFrame, rules=DEFAULT_RULES,
                   keys: tuple[str, ...] = ("entity", "ts")) -> DataFrame:
    """M1: fire every rule whose comparison holds for a snapshot.

    ``metrics`` is long: (entity, ts, metric, value). One aggregate builds a
    metric map per snapshot (bounded by the number of metric names); the rules
    are applied to it as a literal array, so no join is needed.
    """
    # A metric sampled twice in one snapshot counts with its largest value.
    per_metric = metrics.groupBy(*keys, "metric").agg(F.max(F.col("value").cast("double")).alias("value"))
    snap = per_metric.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("_m"))
    rule_arr = F.array(*[F.struct(F.lit(r.metric).alias("metric"), F.lit(r.op).alias("op"),
                                  F.lit(float(r.threshold)).alias("threshold"),
                                  F.lit(r.alert_type).alias("alert_type"),
                                  F.lit(r.severity).alias("severity"),
                                  F.lit(float(r.default)).alias("dflt")) for r in rules])
    x = snap.select(*keys, "_m", F.inline(rule_arr))
    value = F.coalesce(F.element_at(F.col("_m"), F.col("metric")), F.col("dflt"))
    return (x.withColumn("value", value)
             .filter(_compare(F.col("op"), F.col("value"), F.col("threshold")))
             .select(*keys, "alert_type", "severity", "metric", "value"))


def suppress(alerts: DataFrame, cooldown: str = "300 seconds", ts_col: str = "ts",
             keys: tuple[str, ...] = ("entity", "alert_type")) -> DataFrame:
    """M2: greedy cool-down - an alert fires only if no *fired* alert of the
    same (entity, type) is less than ``cooldown`` older (elapsed time in total
    seconds, never wrapped per day).

    An alert that follows the previous one by at least the cool-down always
    fires, so the sequence splits into independent chains at such gaps. From
    each chain start the fired alerts are the path start -> next(start) -> ...,
    where next(a) is the first alert at or after a + cooldown; the paths are
    found by pointer doubling (``_fired_paths``), a logarithmic number of
    joins at any chain length.
    """
    fired = _fired_paths(alerts.select(*keys, F.col(ts_col).alias("_ts")).dropDuplicates([*keys, "_ts"]),
                         list(keys), interval_micros(cooldown))
    return alerts.join(fired.withColumnRenamed("_ts", ts_col), [*keys, ts_col], "left_semi")


def _fired_paths(nodes: DataFrame, keys: list[str], c_us: int) -> DataFrame:
    """Alerts on the next-pointer paths that start at each chain start.

    next(a) = first alert of the key at or after a + c (a backward fill over
    alerts and probe rows, range-partitioned like the other sequence helpers). Pointer
    doubling: ``reached`` holds path positions [0, 2^k) and ``jump`` the
    2^k-th successor; each round adds ``jump(reached)`` and squares ``jump``.
    Every round's frames are checkpointed to the shared checkpoint folder,
    which cuts the lineage and survives lost executors.
    """
    checkpoint_dir(nodes.sparkSession)
    nodes = nodes.checkpoint()
    probes = nodes.select(*keys, F.col("_ts").alias("_src"),
                          F.timestamp_add("MICROSECOND", F.lit(c_us), F.col("_ts")).alias("_t"),
                          F.lit(0).alias("_kind"), F.lit(None).cast(nodes.schema["_ts"].dataType).alias("_v"))
    targets = nodes.select(*keys, F.lit(None).cast(nodes.schema["_ts"].dataType).alias("_src"),
                           F.col("_ts").alias("_t"), F.lit(1).alias("_kind"), F.col("_ts").alias("_v"))
    filled = last_non_null(probes.unionByName(targets), keys, ["_t", "_kind"], "_v", "_nxt",
                           descending=True)
    jump = (filled.filter(F.col("_kind") == 0)
            .select(*keys, F.col("_src").alias("_ts"), F.col("_nxt").alias("_j"))
            .checkpoint())
    prev_ts = previous_row(nodes, keys, ["_ts"], ["_ts"])
    reached = (prev_ts.filter(F.col("prev__ts").isNull() |
                              (micros_between("prev__ts", "_ts") >= F.lit(c_us)))
               .select(*keys, "_ts").checkpoint())
    while True:
        new = (reached.join(jump, [*keys, "_ts"]).filter(F.col("_j").isNotNull())
               .select(*keys, F.col("_j").alias("_ts"))
               .join(reached, [*keys, "_ts"], "left_anti").distinct())
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new).checkpoint()
        nxt = jump.select(*keys, F.col("_ts").alias("_j"), F.col("_j").alias("_j2"))
        jump = (jump.join(nxt, [*keys, "_j"], "left")
                .select(*keys, "_ts", F.col("_j2").alias("_j")).checkpoint())


def low_activity(ticks: DataFrame, minimum: int = 100, period: str = "1 hour") -> DataFrame:
    """M3: per symbol and period, ticks below ``minimum`` -> warning rows."""
    counts = ticks.groupBy("symbol", F.window("timestamp", period).alias("w")).agg(
        F.count(F.lit(1)).alias("tick_count"))
    return (counts.filter(F.col("tick_count") < minimum)
                  .select(F.col("symbol").alias("entity"), F.col("w.start").alias("ts"),
                          F.lit("low_data_activity").alias("alert_type"),
                          F.lit("warning").alias("severity"), "tick_count"))
