"""Rows written to old days while an archive run works are not lost."""

import datetime as dt

from marketlake.plans import lifecycle as lc
from marketlake.sources.archive import read_archive

BASE = dt.datetime(2024, 3, 1)
SCHEMA = "id long, symbol string, timestamp timestamp_ntz"


def at(day, hour=1):
    return BASE + dt.timedelta(days=day, hours=hour)


def test_late_rows_of_archived_days_stay_and_go_with_the_next_run(spark, tmp_path, monkeypatch):
    table, path = "archive_race", str(tmp_path / "archive")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    given = [(i, "A", at(d, h)) for i, (d, h) in enumerate((d, h) for d in range(6) for h in (1, 13))]
    lc.save_partitioned(spark.createDataFrame(given, SCHEMA), table)
    late = [(100, "A", at(0)), (101, "A", at(3, 2)), (102, "A", at(3, 20)), (103, "A", at(5))]
    commit = lc._commit

    def write_late(rows):
        from pyspark.sql import functions as F
        (spark.createDataFrame(rows, SCHEMA).withColumn("date", F.to_date("timestamp")).coalesce(1)
         .write.mode("append").insertInto(table))

    def commit_while_rows_come(*args):
        write_late(late)
        return commit(*args)
    monkeypatch.setattr(lc, "_commit", commit_while_rows_come)
    spark.conf.set("hive.exec.dynamic.partition.mode", "nonstrict")
    cutoff = at(3, 12)
    lc.archive_table(spark, table, cutoff, path, BASE)
    monkeypatch.setattr(lc, "_commit", commit)

    def archived():
        return {r.id for r in read_archive(spark, path, {table: spark.createDataFrame([], SCHEMA).schema})[table].collect()}
    old = {i for i, _, t in given if t < cutoff}
    assert archived() == old
    assert {r.id for r in spark.table(table).collect()} == {i for i, _, _ in given} - old | {100, 101, 102, 103}
    lc.archive_table(spark, table, cutoff, path, BASE)
    assert archived() == old | {100, 101}
    assert {r.id for r in spark.table(table).collect()} == {i for i, _, t in given if t >= cutoff} | {102, 103}
    man = lc.archive_table(spark, table, cutoff, path, BASE).first()
    assert man.record_count == 0
    spark.sql(f"DROP TABLE {table}")
