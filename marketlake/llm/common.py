"""Shared helpers of the corpus operators: row keys, reliable intermediate tables, Arrow row maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Words of the corpus operators: runs of anything but space, \t, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = "\t\n\x0b\x0c\r "


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master may fall back to a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="marketlake-llm-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete a table of ``stored`` that no later step reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def map_columns(df: DataFrame, columns: Sequence[str], schema: str | StructType,
                start: Callable[[], Callable[..., dict]]) -> DataFrame:
    """Arrow map over ``columns``: ``start()`` runs once per task and gives a function from lists to a dict of lists."""
    out = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            got = each(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, out)


def text_key(text: str = "text") -> F.Column:
    """64-bit hash of a text; with ``doc_id`` it tells rows of one id with different texts apart."""
    return F.xxhash64(F.col(text))


def with_bound(rows: int, wanted: int) -> int:
    """Of 1,000,000 hash classes, how many keep about ``wanted`` of ``rows`` rows."""
    return 1_000_000 if rows <= wanted else max(1, wanted * 1_000_000 // rows)


def hash_class(*columns: str) -> F.Column:
    return F.pmod(F.xxhash64(*columns, F.lit(7)), F.lit(1_000_000))
