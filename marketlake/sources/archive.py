"""Re-read archives and incremental snapshots written by ``plans.lifecycle``.

An archive is a directory with one folder per table and, in it, one gzip
JSON-lines folder per run, plus a ``_manifest`` folder. A run counts once its
manifest rows are written: what an interrupted run left behind is never read,
and no run overwrites another. Reading applies the table's schema (no inference) and the
microsecond timestamp formats, so a write/read round trip is exact.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, types as T

from ..functions.timefn import TEXT_TS_OPTIONS

MANIFEST = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("record_count", T.LongType()),
    T.StructField("cutoff", T.TimestampNTZType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("run", T.StringType()),
])


def read_json_table(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**TEXT_TS_OPTIONS).json(path)


def read_archive(spark: SparkSession, path: str,
                 schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Every table of an archive, all committed runs (gzip is decompressed transparently)."""
    manifest = read_json_table(spark, os.path.join(path, "_manifest"), MANIFEST)
    runs = manifest.filter("record_count > 0").select("table_name", "run").distinct().collect()  # one row per run
    out = {}
    for name, schema in schemas.items():
        paths = sorted(run_path(path, name, r["run"]) for r in runs if r["table_name"] == name)
        out[name] = read_json_table(spark, paths, schema) if paths else spark.createDataFrame([], schema)
    out["_manifest"] = manifest
    return out


def run_path(path: str, table: str, run: str) -> str:
    return os.path.join(path, table, f"run-{run}")
