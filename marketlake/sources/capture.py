"""Captured byte streams ``[u32 length][u16 type][body]...`` read in parallel.

A capture file has no markers between frames: where a frame starts is known
only by walking from the start of the file. To let several tasks read one
file it is cut into byte ranges; the frames that *start* in a range belong to
it, and the last of them may end in a later one.

1. Every range guesses its first frame start: the first offset from which
   ``CHAIN`` headers in a row are plausible. It walks from there and notes
   where its walk leaves the range.
2. A guess is right exactly if it is where the walk of the range before
   arrives (the first range starts at 0). Ranges with a wrong guess, or none,
   walk again from the place handed over, until no range disagrees with the one
   before it. So the result never rests on a guess.
3. Every range is read from its proven start and its frames are handed out.

Only the header walk is sequential, and only inside a range; the driver sees
one number, how many ranges disagree. A file that ends inside a frame yields
the bytes that are there (a "truncated frame" for ``decode_frames``); so does a
frame longer than ``MAX_FRAME``, of which the header alone is handed out.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .stores import store_of

SPLIT_BYTES = 128 << 20
CHAIN = 8
HEADER = 6
READ_BYTES = 4 << 20
MAX_FRAME = 64 << 20
BATCH_BYTES = 8 << 20
#: What one task reads at least, where ranges are shorter.
TASK_BYTES = 8 << 20
#: What a guessed header may say; frames outside are found all the same, by the hand-over.
PLAUSIBLE_LENGTH, PLAUSIBLE_TYPE = 1 << 16, 1 << 10

_RANGES = "file string, size long, n long, start long, end long, entry long, exit long"


def open_at(uri: str) -> Callable[[int, int], bytes]:
    """A function that reads ``length`` bytes at an offset of a file (local, or any store pyarrow knows)."""
    store, path = store_of(uri)
    handle = store.open_input_file(path)

    def read(offset: int, length: int) -> bytes:
        handle.seek(offset)
        return handle.read(length)
    return read


class Walk:
    """Headers of a byte stream, read in blocks."""

    def __init__(self, read: Callable[[int, int], bytes], size: int, block: int = READ_BYTES):
        self.read, self.size, self.block, self.base, self.held = read, size, block, 0, b""

    @classmethod
    def over(cls, r: dict) -> Walk:
        """A walk over a range; of a short one no more is read than it holds and a few headers beyond it."""
        return cls(open_at(r["file"]), r["size"], min(READ_BYTES, r["end"] - r["start"] + READ_BYTES // 64))

    def bytes_at(self, pos: int, length: int) -> bytes:
        if not self.base <= pos or pos + length > self.base + len(self.held):
            self.base, self.held = pos, self.read(pos, max(self.block, length))
        return self.held[pos - self.base:pos - self.base + length]

    def after(self, pos: int) -> int | None:
        """Where the frame at ``pos`` ends, or None if not even its header is there."""
        head = self.bytes_at(pos, HEADER)
        return None if len(head) < HEADER else pos + 4 + max(2, struct.unpack_from(">I", head)[0])

    def plausible(self, pos: int) -> bool:
        """Whether ``CHAIN`` frames in a row from ``pos`` look like frames, or run out at the end of the file."""
        for _ in range(CHAIN):
            head = self.bytes_at(pos, HEADER)
            if len(head) < HEADER:
                return False
            length, kind = struct.unpack(">IH", head)
            if not 2 <= length <= PLAUSIBLE_LENGTH or kind >= PLAUSIBLE_TYPE:
                return False
            pos += 4 + length
            if pos == self.size:
                return True
            if pos > self.size:
                return False
        return True

    def guess(self, start: int, end: int) -> int | None:
        """The first plausible frame start of a range."""
        return start if start == 0 else next((p for p in range(start, end) if self.plausible(p)), None)

    def leave(self, entry: int, end: int) -> int:
        """Where a walk from ``entry`` arrives at or beyond ``end``."""
        pos = entry
        while pos < end:
            pos = self.after(pos)
            if pos is None:
                return self.size
        return min(pos, self.size)


def byte_ranges(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, size, n, start, end) of every range; the files are listed by Spark and not read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
    starts = files.where("size > 0").select("file", "size", F.posexplode(
        F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("n", "start"))
    return starts.select("file", "size", F.col("n").cast("long").alias("n"), "start",
                         F.least(F.col("start") + split_bytes, F.col("size")).alias("end"))


def _spread(ranges: DataFrame, tasks: int) -> DataFrame:
    """The rows are small, what they stand for is not: neighbouring ranges go to a task of their own."""
    return ranges.repartitionByRange(max(1, min(tasks, 100_000)), "file", "n")


def _tasks(ranges: DataFrame) -> int:
    """One task per range, or fewer where ranges are short: two per core, or one per ``TASK_BYTES``, are enough."""
    n, size = ranges.agg(F.count(F.lit(1)), F.sum(F.col("end") - F.col("start"))).first()
    return min(n, max(2 * ranges.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // TASK_BYTES)))


def _walked(ranges: DataFrame, tasks: int) -> DataFrame:
    """``ranges`` with entry (guessed where it is null) and exit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                walk = Walk.over(r)
                if r["entry"] is None:
                    r["entry"] = walk.guess(r["start"], r["end"])
                r["exit"] = None if r["entry"] is None else walk.leave(r["entry"], r["end"])
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)
    return _spread(ranges, tasks).mapInArrow(run, _RANGES)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def proven_ranges(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Ranges whose entry is where the walk of the range before arrives."""
    ranges = _written(byte_ranges(spark, path, split_bytes), "capture-ranges")
    null = F.lit(None).cast("long")
    known = _written(_walked(ranges.select("*", null.alias("entry"), null.alias("exit")), _tasks(ranges)),
                     "capture-walked")
    while True:
        handed = known.select("file", (F.col("n") + 1).alias("n"), F.col("exit").alias("handed"))
        # an exit that is not known yet says nothing; the first range without one is settled by the one before it
        wrong = (known.join(handed, ["file", "n"], "left").where("handed is not null and not (handed <=> entry)")
                 .select("file", "size", "n", "start", "end", F.col("handed").alias("entry"), "exit"))
        wrong = _written(wrong, "capture-wrong")
        tasks = _tasks(wrong)
        if not tasks:
            return known
        known = _written(known.join(wrong.select("file", "n"), ["file", "n"], "left_anti").select(*known.columns)
                         .unionByName(_walked(wrong, tasks)), "capture-walked")


def capture_frames(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, offset, frame) of every frame of the capture files under ``path``; input of ``decode_frames``."""
    ranges = proven_ranges(spark, path, split_bytes)
    tasks = _tasks(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                walk = Walk.over(r)
                pos, offsets, frames, held = r["entry"], [], [], 0
                while pos < r["end"]:
                    after = walk.after(pos) or r["size"]
                    frame = walk.bytes_at(pos, min(after, r["size"]) - pos if after - pos <= MAX_FRAME else HEADER)
                    offsets.append(pos)
                    frames.append(frame)
                    held += len(frame)
                    pos = after
                    if held >= BATCH_BYTES:
                        yield _frames_batch(r["file"], offsets, frames)
                        offsets, frames, held = [], [], 0
                if frames:
                    yield _frames_batch(r["file"], offsets, frames)
    return _spread(ranges, tasks).mapInArrow(run, "file string, offset long, frame binary")


def _frames_batch(file: str, offsets: list[int], frames: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(offsets), pa.string()), pa.array(offsets, pa.int64()),
                                       pa.array(frames, pa.binary())], names=["file", "offset", "frame"])


def write_capture(frames: DataFrame, path: str, col: str = "frame") -> int:
    """Write the frames of each partition, in their order, as one capture file; returns the number of bytes.

    A task writes under a name of its own and renames at its end, so a task that runs again replaces its file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        store, folder = store_of(path)
        store.create_dir(folder, recursive=True)
        part, written = TaskContext.get().partitionId(), 0
        draft = f"{folder}/.{part}-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            for batch in batches:
                column = batch.column(0).cast(pa.large_binary())
                if column.null_count:
                    raise ValueError("a frame is null")
                ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
                if len(column) and ends[-1] > ends[0]:      # the frames of a batch lie one behind the other
                    written += out.write(column.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])))
        if written:
            store.move(draft, f"{folder}/capture-{part:06d}.bin")
        else:
            store.delete_file(draft)
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["written"])
    return frames.select(col).mapInArrow(run, "written long").agg(F.sum("written")).first()[0] or 0
