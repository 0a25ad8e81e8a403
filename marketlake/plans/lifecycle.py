"""Table life cycle: E1-E3 CSV export, E4 incremental snapshot, E5 archive,
E6 restore, E7 retention purge, E8 metrics history, W3 partition retention,
A18 manifests.

Parquet has no row deletes. On day-partitioned tables (``purge_table``,
``archive_table``) only the cut-off day is rewritten and older days are dropped
as partitions; the path-based variants split one scan into what leaves and what
stays and write both to *new* paths for the caller to swap. Nothing is collected to the driver: row counts
for manifests come from ``Observation`` metrics gathered during the write.
Text outputs always carry microsecond timestamp formats.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F, types as T

from ..functions.timefn import TEXT_TS_OPTIONS, resolve_as_of, ts_literal
from ..operators.filters import older_than, select_range, since
from ..operators.flow import volume_profile_export
from ..operators.joins import insert_missing
from ..operators.topk import ordered_for_export
from ..sources.archive import MANIFEST, read_archive, read_json_table, run_path


def _write_counted(df: DataFrame, writer) -> int:
    """Run ``writer(df_observed)`` and return the number of rows written."""
    obs = Observation()
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    writer(observed)
    return int(obs.get.get("rows", 0) or 0)


def _csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
       .options(**TEXT_TS_OPTIONS).csv(path))


def _json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "gzip").options(**TEXT_TS_OPTIONS).json(path)


def export_csv(df: DataFrame, path: str, order: list[str]) -> int:
    """Ordered CSV export (O5 ordering: range partitions, sorted within).
    An empty selection writes no files (the reference writes no file then)."""
    if df.isEmpty():
        return 0
    return _write_counted(ordered_for_export(df, order), lambda d: _csv(d, path))


def export_ticks(ticks: DataFrame, path: str, symbol: str | None = None, days: float | None = None,
                 as_of: dt.datetime | None = None) -> int:
    """Ticks of the last ``days`` (optional symbol), ordered by time."""
    sel = select_range(ticks, symbol, days, as_of)
    return export_csv(sel, path, ["timestamp", "id"])


def export_depth(depth: DataFrame, path: str, symbol: str | None = None, days: float | None = None,
                 as_of: dt.datetime | None = None) -> int:
    """Depth rows ordered by (timestamp, side, level)."""
    sel = select_range(depth, symbol, days, as_of)
    return export_csv(sel, path, ["timestamp", "side", "level", "id"])


def export_profile(vp: DataFrame, path: str, symbol: str | None = None, days: float = 1,
                   as_of: dt.datetime | None = None) -> int:
    """The volume-profile export query (A10), ordered by (symbol, price level)."""
    return export_csv(volume_profile_export(vp, days, symbol, as_of), path, ["symbol", "price_level"])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("escape", '"')
            .options(**TEXT_TS_OPTIONS).csv(path))


def manifest(tables: Mapping[str, DataFrame], cutoff: dt.datetime | None,
             created_at: dt.datetime) -> DataFrame:
    """Record count per table with the cut-off and creation time."""
    parts = [df.agg(F.count(F.lit(1)).alias("record_count"))
               .select(F.lit(name).alias("table_name"), "record_count") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", "record_count",
                      (ts_literal(cutoff) if cutoff else F.lit(None).cast("timestamp_ntz")).alias("cutoff"),
                      ts_literal(created_at).alias("created_at"))


def _run_id(cutoff: dt.datetime) -> str:
    return f"{cutoff:%Y%m%dT%H%M%S}-{uuid.uuid4().hex}"


def _write_run(df: DataFrame, path: str, table: str, run: str) -> int:
    """Write one table of a run to its own new folder, read it back and compare; returns its rows."""
    target = run_path(path, table, run)
    n = _write_counted(df, lambda d: _json(d, target, "error"))
    back = read_json_table(df.sparkSession, target, df.schema).count() if n else 0
    if back != n:
        raise OSError(f"{target} holds {back} of {n} rows")
    return n


def _commit(spark: SparkSession, path: str, counts: Mapping[str, int], cutoff, created_at, run: str) -> DataFrame:
    """Append the manifest rows of a run: from now on readers see it."""
    rows = [(name, int(n), cutoff, created_at, run) for name, n in counts.items()]
    man = spark.createDataFrame(rows, MANIFEST)
    _json(man.coalesce(1), os.path.join(path, "_manifest"), "append")
    return man


def incremental_snapshot(spark: SparkSession, tables: Mapping[str, DataFrame], start: dt.datetime,
                         path: str, created_at: dt.datetime,
                         ts_cols: Mapping[str, str] | None = None) -> DataFrame:
    """Rows newer than ``start`` of each table -> gzip JSON per table, plus
    a manifest. Every run has its own folders and counts once its manifest rows
    are written. Returns the manifest of this run."""
    run = _run_id(start)
    counts = {name: _write_run(since(df, start, (ts_cols or {}).get(name, "timestamp")), path, name, run)
              for name, df in tables.items()}
    return _commit(spark, path, counts, start, created_at, run)


def archive(spark: SparkSession, tables: Mapping[str, DataFrame], cutoff: dt.datetime,
            archive_path: str, kept_path: str, created_at: dt.datetime) -> DataFrame:
    """E5: rows older than ``cutoff`` go to the archive (gzip JSON), the rest is
    written to ``kept_path/<table>`` (Parquet, partitioned by date) for the
    caller to swap in. Tables with nothing to archive are left as they are
    (no-op). The manifest is committed last, so an interrupted run leaves the
    tables and the archive as they were. Returns the manifest of this run."""
    run, counts = _run_id(cutoff), {}
    for name, df in tables.items():
        old = older_than(df, cutoff)
        if old.isEmpty():
            counts[name] = 0
            continue
        counts[name] = _write_run(old, archive_path, name, run)
        keep = df.filter(F.col("timestamp") >= ts_literal(cutoff))
        (keep.withColumn("date", F.to_date("timestamp")).write.mode("overwrite")
             .partitionBy("date").parquet(os.path.join(kept_path, name)))
    return _commit(spark, archive_path, counts, cutoff, created_at, run)


def restore(spark: SparkSession, archive_path: str, current: Mapping[str, DataFrame],
            schemas: Mapping[str, T.StructType], keys: Mapping[str, list[str]]) -> dict[str, DataFrame]:
    """Archived rows are inserted where their business keys are absent,
    so restoring twice adds nothing."""
    arch = read_archive(spark, archive_path, dict(schemas))
    return {name: insert_missing(current[name], arch[name].select(*current[name].columns), keys[name])
            for name in current}


def purge(df: DataFrame, cutoff: dt.datetime, ts_col: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """(rows kept, one-row count of rows deleted) for a retention cut-off."""
    kept = df.filter(F.col(ts_col) >= ts_literal(cutoff))
    deleted = older_than(df, cutoff, ts_col).agg(F.count(F.lit(1)).alias("deleted_rows"))
    return kept, deleted


# Fixed value of the reference: default retention / archive age in days.
DEFAULT_RETENTION_DAYS = 30


def retention_cutoff(as_of: dt.datetime, days: float = DEFAULT_RETENTION_DAYS) -> dt.datetime:
    return as_of - dt.timedelta(days=days)


def append_metrics(metrics: DataFrame, path: str, ts_col: str = "ts") -> None:
    """Append a metrics table as JSON, one folder per day."""
    (metrics.withColumn("date", F.to_date(ts_col)).write.mode("append").partitionBy("date")
            .options(**TEXT_TS_OPTIONS).json(path))


def partition_retention(df: DataFrame, keep_days: int, keep_count: int,
                        as_of: dt.datetime | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Per key, a day partition is deleted only if it is not among the
    newest ``keep_count`` partitions *and* older than ``keep_days``.

    Works on the partition list (one row per key and day, tiny), so the
    ranking never touches raw rows. Returns (keys, day, rows, rank, keep).
    """
    anchor = resolve_as_of(df, as_of)
    cutoff = dt.datetime.combine((anchor - dt.timedelta(days=keep_days)).date(), dt.time())
    parts = df.groupBy(*keys, _day("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("day").desc())).cast("bigint")
    return (parts.withColumn("rank", rank)
                 .withColumn("keep", (F.col("rank") <= keep_count) | (F.col("day") >= ts_literal(cutoff))))


def _day(col: str):
    return F.date_trunc("day", F.col(col)).cast("timestamp_ntz")


def apply_retention(df: DataFrame, plan: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rows of the partitions W3 keeps (semi join on the small partition list)."""
    kept = plan.filter("keep").select(*keys, "day")
    return df.withColumn("day", _day("timestamp")).join(kept, [*keys, "day"], "left_semi").drop("day")


# ------------------------------------------------------------------ partitioned tables
#
# On a table partitioned by day a retention delete touches at most one day of
# data: whole days before the cut-off day are dropped as partitions (files and
# metadata of a managed table), the cut-off day is written without its old rows
# to a new folder of the table and the partition pointed there (one metadata
# step: a job that dies before it leaves the day as it was), and every later day
# is left alone.

def save_partitioned(df: DataFrame, table: str, ts_col: str = "timestamp") -> None:
    """Store an event frame as a managed table partitioned by ``date``."""
    (df.withColumn("date", F.to_date(F.col(ts_col))).repartitionByRange("date", ts_col)
       .sortWithinPartitions("date", ts_col).write.mode("overwrite").partitionBy("date").saveAsTable(table))


def _partition_days(spark: SparkSession, table: str) -> list[dt.date]:
    rows = spark.sql(f"SHOW PARTITIONS {table}").collect()      # one short string per day
    return sorted(dt.date.fromisoformat(r[0].split("=", 1)[1]) for r in rows)


def purge_table(spark: SparkSession, table: str, cutoff: dt.datetime, ts_col: str = "timestamp") -> int:
    """E7 on a day-partitioned table; returns the number of rows deleted."""
    tbl = spark.table(table)
    deleted = tbl.filter(F.col("date") <= F.lit(cutoff.date())).filter(
        F.col(ts_col) < ts_literal(cutoff)).count()
    cut_day = cutoff.date()
    days = _partition_days(spark, table)
    if cut_day in days:
        day = tbl.filter(F.col("date") == F.lit(cut_day))          # partition pruning: one day read
        keep = day.filter(F.col(ts_col) >= ts_literal(cutoff))
        if keep.isEmpty():
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (date='{cut_day.isoformat()}')")
        elif not day.filter(F.col(ts_col) < ts_literal(cutoff)).isEmpty():
            home = next(r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()
                        if r["col_name"] == "Location")
            kept = f"{home}/kept-{cut_day.isoformat()}-{uuid.uuid4().hex}"
            keep.drop("date").write.parquet(kept)
            spark.sql(f"ALTER TABLE {table} PARTITION (date='{cut_day.isoformat()}') SET LOCATION '{kept}'")
            spark.sql(f"REFRESH TABLE {table}")
    for d in days:
        if d < cut_day:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (date='{d.isoformat()}')")
    return deleted


def archive_table(spark: SparkSession, table: str, cutoff: dt.datetime, archive_path: str,
                  created_at: dt.datetime, ts_col: str = "timestamp") -> DataFrame:
    """E5 on a day-partitioned table: rows before ``cutoff`` are written to the
    archive (gzip JSON, a new folder for every run), the manifest is committed,
    and only then are they removed.

    The run reads a fixed list of files, those of the days up to the cut-off when
    it starts, and removes exactly those: a row that is written to an old day
    while the run works is in another file, stays, and goes with the next run. A
    run that is interrupted may be run again: before the commit nothing was
    removed, after it every removed row is in a committed run (rows not yet
    removed are archived once more; ``restore`` inserts each key once). No-op
    when nothing is old enough. Returns the manifest of this run."""
    spark.sql(f"REFRESH TABLE {table}")
    days = spark.table(table).filter(F.col("date") <= F.lit(cutoff.date()))
    files = days.inputFiles()       # names; one entry per file of the days up to the cut-off
    schema = T.StructType([f for f in spark.table(table).schema.fields if f.name != "date"])
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    old = rows.filter(F.col(ts_col) < ts_literal(cutoff))
    run = _run_id(cutoff)
    n = 0 if old.isEmpty() else _write_run(old, archive_path, table, run)
    man = _commit(spark, archive_path, {table: n}, cutoff, created_at, run)
    if n:
        _remove_files(spark, table, set(files), cutoff, schema, ts_col)
    return man


def _files_of(spark: SparkSession, table: str, day: dt.date) -> set[str]:
    spark.sql(f"REFRESH TABLE {table}")
    return set(spark.table(table).filter(F.col("date") == F.lit(day)).inputFiles())


def _remove_files(spark: SparkSession, table: str, files: set[str], cutoff: dt.datetime, schema: T.StructType, ts_col: str) -> None:
    """Remove the rows before ``cutoff`` of ``files`` from the table; files that came since stay.

    Whole days go as partitions where no other file has come, else file by file. The cut-off's day moves to a new folder
    with the rows to keep and all rows of files that came since, also of those that come until the partition points there."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def delete(names: set[str]) -> None:
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, False)
    for day in _partition_days(spark, table):
        now = _files_of(spark, table, day) if day <= cutoff.date() else set()
        done = now & files
        if not done:
            continue
        spec = f"PARTITION (date='{day.isoformat()}')"
        if day < cutoff.date():
            if now == done:
                spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {spec}")
            else:
                delete(done)
            continue
        home = next(r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r["col_name"] == "Location")
        kept = f"{home}/kept-{day.isoformat()}-{uuid.uuid4().hex}"
        reader = spark.read.schema(schema)
        reader.parquet(*done).filter(F.col(ts_col) >= ts_literal(cutoff)).write.parquet(kept)
        moved = now - done
        if moved:
            reader.parquet(*moved).write.mode("append").parquet(kept)
        spark.sql(f"ALTER TABLE {table} {spec} SET LOCATION '{kept}'")
        folders = {f.rsplit("/", 1)[0] for f in now}
        came = {f for folder in folders for f in spark.read.schema(schema).parquet(folder).inputFiles()} - now
        if came:
            reader.parquet(*came).write.mode("append").parquet(kept)
    spark.sql(f"REFRESH TABLE {table}")
