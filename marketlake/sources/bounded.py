"""A row-bounded stream over a folder of Parquet files.

The collector writes when 100 rows wait or 5 seconds have passed, and never
holds more than 10 000. File sources bound a micro-batch by files or bytes;
this source bounds it by rows: a batch is due when ``batch_rows`` rows wait, or
when rows have waited for ``batch_seconds``, and takes ``max_rows`` at most.

A micro-batch of Spark has a fixed price, so a backlog of many batches may run
several of them side by side: with ``batches_per_trigger`` above 1 a micro-batch
takes up to that many whole batches, each with its own number in
``batch_column`` and none above the bound. ``jobs.write_batches`` gives each its
own folder, written by one task.

Spark asks a Python source for its newest offset without saying where the
query stands, so admissions are written ahead: before an offset leaves the
source, the slices of files it admits (file, first row, last row; per batch) are stored
in ``log`` (a shared folder, one per query). A restarted source first offers
the last admission again; Spark has either run it or runs it now, and a batch
that is run again reads the same slices, whatever files have come since.
Entries behind a committed offset are folded into one snapshot.

Files must appear complete (written elsewhere and renamed, as Spark does), and
are not changed afterwards. They are read by row groups, one task each, from
the group's first row to the last that is wanted.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .stores import store_of

FORMAT = "row_bounded_parquet"
# Fixed values of the reference: collector batching knobs.
BATCH_ROWS, BATCH_SECONDS, MAX_ROWS = 100, 5.0, 10_000
DECODE_ROWS = 1 << 16


class Slice(InputPartition):
    """Parts (first row, last row, batch) of one row group, whose first row is ``base`` rows into the file."""

    def __init__(self, file: str, group: int, base: int, parts: list[tuple[int, int, int]]):
        self.file, self.group, self.base, self.parts = file, group, base, parts


class AdmissionLog:
    """Admitted batches by the offset at which they end, the rows taken of each file and the batches so far."""

    def __init__(self, uri: str):
        self.store, self.folder = store_of(uri)
        self.store.create_dir(self.folder, recursive=True)
        names = sorted(f.base_name for f in self._files())
        snapshots = [n for n in names if n.startswith("taken-")]
        base = self._load(snapshots[-1]) if snapshots else {"end": 0, "taken": {}, "batches": 0}
        self.end, self.taken, self.batches, self.entries = base["end"], dict(base["taken"]), base.get("batches", 0), {}
        for name in (n for n in names if n.startswith("admitted-")):
            entry = self._load(name)
            if "slices" in entry:   # written before batches had numbers
                entry |= {"first": self.batches, "batches": [entry["slices"]]}
            self.entries[entry["end"]] = entry
            if entry["end"] > base["end"]:
                self._apply(entry)

    def _files(self):
        from pyarrow import fs
        return self.store.get_file_info(fs.FileSelector(self.folder))

    def _load(self, name: str) -> dict:
        with self.store.open_input_file(f"{self.folder}/{name}") as f:
            return json.loads(f.read())

    def _save(self, name: str, content: dict) -> None:
        with self.store.open_output_stream(f"{self.folder}/.{name}") as f:
            f.write(json.dumps(content).encode())
        self.store.move(f"{self.folder}/.{name}", f"{self.folder}/{name}")

    def _apply(self, entry: dict) -> None:
        for file, _, high in (s for slices in entry["batches"] for s in slices):
            self.taken[file] = max(high, self.taken.get(file, 0))
        self.end = max(self.end, entry["end"])
        self.batches = max(self.batches, entry["first"] + len(entry["batches"]))

    def admit(self, batches: list[list[list]]) -> None:
        rows = sum(high - low for slices in batches for _, low, high in slices)
        entry = {"start": self.end, "end": self.end + rows, "first": self.batches, "batches": batches}
        self._save(f"admitted-{entry['end']:020d}.json", entry)
        self.entries[entry["end"]] = entry
        self._apply(entry)

    def between(self, start: int, end: int) -> list[tuple]:
        """(file, first row, last row, batch) of what was admitted between two offsets."""
        found = sorted((e for e in self.entries.values() if start < e["end"] <= end), key=lambda e: e["end"])
        return [(*s, e["first"] + n) for e in found for n, slices in enumerate(e["batches"]) for s in slices]

    def settle(self, end: int) -> None:
        """Fold entries up to ``end`` into a snapshot; the entry of ``end`` itself stays, for a batch run again."""
        done = sorted(e for e in self.entries if e < end)
        if not done:
            return
        taken: dict = {}
        old = sorted(f.base_name for f in self._files() if f.base_name.startswith("taken-"))
        if old:
            taken = self._load(old[-1])["taken"]
        for e in done:
            for file, _, high in (s for slices in self.entries[e]["batches"] for s in slices):
                taken[file] = max(high, taken.get(file, 0))
        last = self.entries[done[-1]]
        self._save(f"taken-{done[-1]:020d}.json", {"end": done[-1], "taken": taken,
                                                   "batches": last["first"] + len(last["batches"])})
        for name in old + [f"admitted-{e:020d}.json" for e in done]:
            self.store.delete_file(f"{self.folder}/{name}")
        for e in done:
            del self.entries[e]


class RowBoundedReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.schema = schema
        self.batch_rows = int(options.get("batchrows", BATCH_ROWS))
        self.batch_seconds = float(options.get("batchseconds", BATCH_SECONDS))
        self.max_rows = int(options.get("maxrows", MAX_ROWS))
        self.batches_per_trigger = int(options.get("batchespertrigger", 1))
        self.batch_column = options.get("batchcolumn")
        self.store, self.folder = store_of(options["path"])
        self.log = AdmissionLog(options["log"])
        self.offer_again = self.log.end > 0
        self.rows: dict[str, int] = {}
        self.waiting_since: float | None = None

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def _waiting(self) -> list[list]:
        """[file, first row, last row] of what is not admitted, oldest files first, a little more than one trigger takes."""
        from pyarrow import fs
        found = self.store.get_file_info(fs.FileSelector(self.folder, recursive=True, allow_not_found=True))
        files = [f for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet")
                 and not any(p.startswith(("_", ".")) for p in f.path[len(self.folder):].split("/"))]
        out, total = [], 0
        for f in sorted(files, key=lambda f: (f.mtime_ns or 0, f.path)):
            taken = self.log.taken.get(f.path, 0)
            if f.path not in self.rows:
                with self.store.open_input_file(f.path) as handle:
                    self.rows[f.path] = pq.ParquetFile(handle).metadata.num_rows
            if self.rows[f.path] > taken:
                out.append([f.path, taken, self.rows[f.path]])
                total += self.rows[f.path] - taken
                if total >= max(self.max_rows * self.batches_per_trigger, self.batch_rows):
                    break
        return out

    def latestOffset(self) -> dict:
        if self.offer_again:
            self.offer_again = False
            return {"rows": self.log.end}
        waiting = self._waiting()
        total = sum(high - low for _, low, high in waiting)
        if total and self.waiting_since is None:
            self.waiting_since = time.monotonic()
        if total and (total >= self.batch_rows or time.monotonic() - self.waiting_since >= self.batch_seconds):
            self.log.admit(self._batches(waiting, time.monotonic() - self.waiting_since >= self.batch_seconds))
            self.waiting_since = None
        return {"rows": self.log.end}

    def _batches(self, waiting: list[list], waited: bool) -> list[list[list]]:
        """What waits, cut into batches in order; after the first, one that is not full must be due as well."""
        out: list[list[list]] = [[]]
        left = self.max_rows
        for file, low, high in waiting:
            while low < high and (left or len(out) < self.batches_per_trigger):
                if not left:
                    out.append([])
                    left = self.max_rows
                out[-1].append([file, low, min(high, low + left)])
                left -= out[-1][-1][2] - low
                low = out[-1][-1][2]
        if len(out) > 1 and left and self.max_rows - left < self.batch_rows and not waited:
            out.pop()
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        wanted: dict[str, list[tuple]] = {}
        for file, *part in self.log.between(start["rows"], end["rows"]):
            wanted.setdefault(file, []).append(tuple(part))
        out = []
        for file, parts in wanted.items():
            with self.store.open_input_file(file) as handle:
                meta = pq.ParquetFile(handle).metadata
            base = 0
            for group in range(meta.num_row_groups):
                until = base + meta.row_group(group).num_rows
                inside = [(max(low, base), min(high, until), n) for low, high, n in parts if base < high and until > low]
                if inside:
                    out.append(Slice(file, group, base, inside))
                base = until
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(self.schema)
        stored = pa.schema([f for f in wanted if f.name != self.batch_column])
        at = partition.base
        with self.store.open_input_file(partition.file) as handle:
            for rows in pq.ParquetFile(handle).iter_batches(DECODE_ROWS, [partition.group], stored.names):
                for low, high, number in partition.parts:
                    first, last = max(low, at), min(high, at + rows.num_rows)
                    if first < last:
                        table = pa.Table.from_batches([rows.slice(first - at, last - first)]).select(stored.names).cast(stored)
                        if self.batch_column:
                            table = table.append_column(self.batch_column, pa.array([number] * len(table), pa.int64()))
                        yield from table.select(wanted.names).to_batches()
                at += rows.num_rows
                if at >= partition.parts[-1][1]:
                    return

    def commit(self, end: dict) -> None:
        self.log.settle(end["rows"])

    def stop(self) -> None:
        pass


class RowBoundedParquet(DataSource):
    """``spark.readStream.format("row_bounded_parquet")`` with options path, log, batchRows, batchSeconds, maxRows,
    batchesPerTrigger and batchColumn (a long column of the schema that is not in the files)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        store, folder = store_of(self.options["path"])
        from pyarrow import fs
        first = min(f.path for f in store.get_file_info(fs.FileSelector(folder, recursive=True))
                    if f.path.endswith(".parquet") and "/_" not in f.path[len(folder):])
        with store.open_input_file(first) as handle:
            found = from_arrow_schema(pq.ParquetFile(handle).schema_arrow, prefer_timestamp_ntz=True)
        column = self.options.get("batchColumn")
        return found.add(column, "long") if column else found

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return RowBoundedReader({k.lower(): v for k, v in dict(self.options).items()}, schema)


def bounded_stream(spark: SparkSession, path: str, log: str, schema: StructType | None = None, batch_rows: int = BATCH_ROWS,
                   batch_seconds: float = BATCH_SECONDS, max_rows: int = MAX_ROWS, batches_per_trigger: int = 1,
                   batch_column: str | None = None) -> DataFrame:
    """The Parquet files under ``path`` as a stream of batches that hold ``max_rows`` rows at most. A micro-batch takes
    one, or of a backlog up to ``batches_per_trigger``; ``batch_column`` then tells them apart (numbers from 0)."""
    if batches_per_trigger > 1 and not batch_column:
        raise ValueError("several batches in a micro-batch need a batch_column")
    spark.dataSource.register(RowBoundedParquet)
    reader = spark.readStream.format(FORMAT).option("path", path).option("log", log)
    if batch_column:
        reader = reader.option("batchColumn", batch_column)
    if schema is not None:
        reader = reader.schema(StructType([*schema.fields, StructField(batch_column, LongType())]) if batch_column else schema)
    return (reader.option("batchRows", batch_rows).option("batchSeconds", batch_seconds).option("maxRows", max_rows)
            .option("batchesPerTrigger", batches_per_trigger).load())
