"""Capture files: the same frames however a file is cut, and several tasks per file."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from marketlake import frame_fixtures as ff
from marketlake.plans import catalog_io
from marketlake.sources import capture as cap, frames as fr


def frame(kind: int, body: bytes) -> bytes:
    return struct.pack(">IH", len(body) + 2, kind) + body


def stream(seed: int, count: int = 14) -> list[bytes]:
    """Trades, quotes, empty bodies, unknown and implausible types, bodies that look like headers, tiny lengths."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        symbol = rng.choice((b"ESZ23", b"CL", b"\x00\x00\x00\x02\x00\x66"))
        trade = struct.pack(">I", len(symbol)) + symbol + struct.pack(">dIQ", rng.random() * 100, 3, 1_700_000_000_000)
        out.append(rng.choice((frame(102, trade), frame(109, b""), frame(60_000, b"\x00\x00\x00\x02\x00\x66" * 9),
                               struct.pack(">IH", rng.choice((0, 1)), 5), frame(103, bytes(40)))))
    return out


def reader(data: bytes):
    return lambda offset, length: data[offset:offset + length]


def test_a_file_cut_at_every_offset_gives_the_same_frames():
    for seed in range(20):
        frames = stream(seed)
        data = b"".join(frames)
        starts = [sum(map(len, frames[:i])) for i in range(len(frames))]
        for cut in range(1, len(data)):
            walk = cap.Walk(reader(data), len(data), block=32)
            handed = walk.leave(0, cut)
            assert handed == next((s for s in starts if s >= cut), len(data))
            guess = walk.guess(cut, len(data))
            # a guess may be wrong, the walk of the range before is not; a right guess needs no second walk
            assert guess is None or guess >= cut
            assert walk.leave(handed, len(data)) == len(data)


@pytest.mark.parametrize("split", [5, 37, 400, 1 << 20])
def test_ranges_of_any_size_give_all_frames(spark, tmp_path, split):
    want = []
    for n, seed in enumerate((1, 2, 3)):
        frames = stream(seed, 12)
        data = b"".join(frames) + (b"\x00\x00\x00\x1e\x00\x66\x00\x00" if n == 1 else b"\x00\x00\x00" if n == 2 else b"")
        (tmp_path / f"{n}.bin").write_bytes(data)
        want += [(f"{n}.bin", sum(map(len, frames[:i])), f) for i, f in enumerate(frames)]
        if n:
            want.append((f"{n}.bin", len(data) - (8 if n == 1 else 3), data[-8 if n == 1 else -3:]))
    (tmp_path / "3.bin").write_bytes(b"")
    got = cap.capture_frames(spark, str(tmp_path), split)
    assert sorted((r.file.rsplit("/", 1)[1], r.offset, bytes(r.frame)) for r in got.collect()) == sorted(want)
    _, rejects = fr.decode_frames(got)
    assert rejects.where("offset > 0 and reject_reason = 'truncated frame'").count() >= 2


def test_several_tasks_read_one_file_and_a_giant_frame_spans_ranges(spark, tmp_path):
    data = frame(109, b"") * 50 + frame(110, b"\x07" * 5000) + frame(109, b"") * 50
    (tmp_path / "one.bin").write_bytes(data)
    frames = cap.capture_frames(spark, str(tmp_path), 256)
    assert frames.rdd.getNumPartitions() > 4 and frames.count() == 101
    assert frames.selectExpr("max(length(frame))").first()[0] == 5006
    per_task = frames.groupBy("file").agg({"offset": "count"}).first()
    assert per_task[1] == 101


def test_garbage_length_ends_the_file(spark, tmp_path):
    (tmp_path / "bad.bin").write_bytes(frame(109, b"") * 5 + b"\xff\xff\xff\xff\x00\x66" + frame(109, b"") * 200)
    frames = cap.capture_frames(spark, str(tmp_path), 64)
    got = sorted((r.offset, len(r.frame)) for r in frames.collect())
    assert [o for o, _ in got] == [0, 6, 12, 18, 24, 30]
    assert [r.reject_reason for r in fr.decode_frames(frames)[1].collect()] == ["truncated frame"]


def test_written_captures_hold_every_frame(spark):
    table = catalog_io.frame_table(spark, SMALL)
    got = catalog_io.captured(spark, SMALL)
    assert got.count() == table.count() and got.select("file").distinct().count() == 2
    assert got.select("frame").exceptAll(table.select("frame")).count() == 0


def test_short_ranges_read_no_more_than_they_hold_and_share_tasks(spark, tmp_path, monkeypatch):
    frames = spark.range(40_000).select("id", F.concat(F.unhex(F.lit("0000001A006D")), F.unhex(F.lit("00" * 24))).alias("frame"))
    path = str(tmp_path / "one")
    assert cap.write_capture(frames.coalesce(1), path) == 40_000 * 30
    ranges = cap.byte_ranges(spark, path, 1 << 12)
    assert ranges.count() > 290 and cap._tasks(ranges) == 2 * spark.sparkContext.defaultParallelism
    r = ranges.where("n = 3").first().asDict()
    reads = []
    monkeypatch.setattr(cap, "open_at", lambda uri: lambda offset, length: reads.append(length) or bytes(length))
    cap.Walk.over(r).bytes_at(r["start"], 6)
    assert reads == [(1 << 12) + cap.READ_BYTES // 64]
    monkeypatch.undo()
    assert cap.capture_frames(spark, path, 1 << 12).count() == 40_000
    with pytest.raises(Exception):
        cap.write_capture(spark.sql("select cast(null as binary) as frame"), str(tmp_path / "null"))


def test_doubles_of_frames_equal_their_bit_patterns(spark):
    values = [0.0, -0.0, 1.5, -2.75, 1e-310, -5e-324, 1.7e308, float("inf"), float("-inf"), float("nan"), 0.1, 123456.789, None]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(
        "x", ff.f64_bytes("x").alias("b"), F.unhex(F.lpad(F.hex(ff.f64_bits(F.col("x"))), 16, "0")).alias("want")).collect()
    assert len(got) == len(values) and all(r.b == r.want for r in got)


def test_garbled_symbols_of_a_batch_leave_the_others(spark):
    good = "0000001E0066" + "00000004" + "45535A35" + "3FF0000000000000" + "00000001" + "0000000000000001"
    bad = good.replace("45535A35", "FFFEFDFC")
    dec, rejects = fr.decode_frames(spark.createDataFrame([(1, good), (2, bad), (3, good)], "id long, h string").select(
        "id", F.unhex("h").alias("frame")).coalesce(1))
    assert sorted((r.id, r.symbol, r.price) for r in dec.collect()) == [(1, "ESZ5", 1.0), (3, "ESZ5", 1.0)]
    assert [(r.id, r.reject_reason) for r in rejects.collect()] == [(2, "symbol is no UTF-8")]
