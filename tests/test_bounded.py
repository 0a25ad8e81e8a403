"""The row-bounded source: bound, waiting, replay after a restart, files that arrive late."""

import os
import time

import pytest

from marketlake.sources import bounded
from marketlake.streaming import jobs

SCHEMA = "id long, symbol string, price decimal(20,8), timestamp timestamp_ntz"


def write(spark, src, low, high, files=1):
    import datetime as dt
    rows = [(i, "AB"[i % 2], None, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)) for i in range(low, high)]
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("append").parquet(src)


def run(spark, tmp_path, **bounds):
    from pyspark.sql.types import _parse_datatype_string
    stream = bounded.bounded_stream(spark, str(tmp_path / "src"), str(tmp_path / "log"), _parse_datatype_string(SCHEMA), **bounds)
    jobs.drain(jobs.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), available_now=False, interval="0 seconds"))
    return {r.batch_id: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("batch_id").count().collect()}


def ids(spark, tmp_path, where="true"):
    return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).where(where).collect())


def forget(ckpt, batch):
    for name in (f"{ckpt}/commits/{batch}", f"{ckpt}/commits/.{batch}.crc"):
        if os.path.exists(name):
            os.unlink(name)


def test_no_batch_above_the_bound_and_a_batch_run_again_reads_the_same_rows(spark, tmp_path):
    write(spark, str(tmp_path / "src"), 0, 200, 3)
    sizes = run(spark, tmp_path, batch_rows=50, batch_seconds=0, max_rows=70)
    assert [sizes[b] for b in sorted(sizes)] == [70, 70, 60] and ids(spark, tmp_path) == list(range(200))
    last = ids(spark, tmp_path, "batch_id = 2")
    # the last batch was written but not committed when the job died; more files have come since
    forget(tmp_path / "ckpt", 2)
    write(spark, str(tmp_path / "src"), 200, 290)
    sizes = run(spark, tmp_path, batch_rows=50, batch_seconds=0, max_rows=70)
    assert ids(spark, tmp_path, "batch_id = 2") == last and ids(spark, tmp_path) == list(range(290))
    assert [sizes[b] for b in sorted(sizes)] == [70, 70, 60, 70, 20]


def test_a_restart_with_nothing_new_and_one_with_another_bound(spark, tmp_path):
    write(spark, str(tmp_path / "src"), 0, 100)
    assert run(spark, tmp_path, batch_rows=10, batch_seconds=0, max_rows=40) == {0: 40, 1: 40, 2: 20}
    assert run(spark, tmp_path, batch_rows=10, batch_seconds=0, max_rows=40) == {0: 40, 1: 40, 2: 20}
    write(spark, str(tmp_path / "src"), 100, 130)
    run(spark, tmp_path, batch_rows=10, batch_seconds=0, max_rows=25)
    assert ids(spark, tmp_path) == list(range(130))
    assert len([n for n in os.listdir(tmp_path / "log") if n.startswith("taken-")]) == 1


@pytest.fixture
def reader(spark, tmp_path):
    def make(**options):
        from pyspark.sql.types import _parse_datatype_string
        return bounded.RowBoundedReader({"path": str(tmp_path / "src"), "log": str(tmp_path / "log"), **options},
                                        _parse_datatype_string(SCHEMA))
    return make


def test_few_rows_wait_for_the_timeout(spark, tmp_path, reader):
    write(spark, str(tmp_path / "src"), 0, 30)
    r = reader(batchrows="100", batchseconds="1.5", maxrows="1000")
    assert r.latestOffset() == {"rows": 0}
    write(spark, str(tmp_path / "src"), 30, 60)
    assert r.latestOffset() == {"rows": 0}
    time.sleep(1.6)
    assert r.latestOffset() == {"rows": 60}
    write(spark, str(tmp_path / "src"), 60, 180)
    assert r.latestOffset() == {"rows": 180}     # a full batch does not wait
    # an admission that Spark never saw is offered again by the next source, and its rows are the same
    again = reader(batchrows="100", batchseconds="0", maxrows="1000")
    write(spark, str(tmp_path / "src"), 180, 181)
    assert again.latestOffset() == {"rows": 180} and again.latestOffset() == {"rows": 181}
    rows = [i for p in again.partitions({"rows": 60}, {"rows": 180}) for b in again.read(p) for i in b.column(0).to_pylist()]
    assert sorted(rows) == list(range(60, 180))


def test_files_in_the_making_are_not_read(spark, tmp_path, reader):
    write(spark, str(tmp_path / "src"), 0, 120)
    os.makedirs(tmp_path / "src" / "_temporary" / "0")
    (tmp_path / "src" / "_temporary" / "0" / "x.parquet").write_bytes(b"half")
    (tmp_path / "src" / ".y.parquet").write_bytes(b"half")
    assert reader(batchseconds="0").latestOffset() == {"rows": 120}


def test_a_backlog_runs_many_batches_side_by_side(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string(SCHEMA)

    def run_several():
        stream = bounded.bounded_stream(spark, str(tmp_path / "src"), str(tmp_path / "log"), schema, batch_rows=10, batch_seconds=0,
                                        max_rows=30, batches_per_trigger=4, batch_column="batch")
        jobs.drain(jobs.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), available_now=False,
                                      interval="0 seconds", batch_column="batch"))
        found = spark.read.parquet(str(tmp_path / "out")).groupBy("batch_id", "batch").count().collect()
        return {(r.batch_id, r.batch): r["count"] for r in found}
    write(spark, str(tmp_path / "src"), 0, 200, 3)
    want = {(0, n): 30 for n in range(4)} | {(1, 4): 30, (1, 5): 30, (1, 6): 20}
    assert run_several() == want and ids(spark, tmp_path) == list(range(200))
    assert len(list((tmp_path / "out").glob("*/*/*.parquet"))) == 7     # a batch is written by one task
    last = ids(spark, tmp_path, "batch = 5")
    forget(tmp_path / "ckpt", 1)
    write(spark, str(tmp_path / "src"), 200, 245)
    assert run_several() == want | {(2, 7): 30, (2, 8): 15} and ids(spark, tmp_path) == list(range(245))
    assert ids(spark, tmp_path, "batch = 5") == last
    with pytest.raises(ValueError):
        bounded.bounded_stream(spark, str(tmp_path / "src"), str(tmp_path / "log"), schema, batches_per_trigger=2)


def test_a_batch_that_is_not_full_waits_behind_full_ones(spark, tmp_path, reader):
    write(spark, str(tmp_path / "src"), 0, 65)
    r = reader(batchrows="20", batchseconds="60", maxrows="30", batchespertrigger="5", batchcolumn="batch")
    assert r.latestOffset() == {"rows": 60} and r.latestOffset() == {"rows": 60}


def test_one_slice_of_a_large_row_group_does_not_decode_the_rest(spark, tmp_path, reader, monkeypatch):
    write(spark, str(tmp_path / "src"), 0, 1000)
    monkeypatch.setattr(bounded, "DECODE_ROWS", 100)
    decoded = []
    whole = bounded.pq.ParquetFile.iter_batches

    def counted(*args):
        for rows in whole(*args):
            decoded.append(rows.num_rows)
            yield rows
    monkeypatch.setattr(bounded.pq.ParquetFile, "iter_batches", counted)
    r = reader(batchrows="1", batchseconds="0", maxrows="150")
    assert r.latestOffset() == {"rows": 150}
    parts = r.partitions({"rows": 0}, {"rows": 150})
    assert sum(b.num_rows for p in parts for b in r.read(p)) == 150 and sum(decoded) == 200
