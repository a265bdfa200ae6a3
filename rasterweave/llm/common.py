"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one
    of our own where that is unset and all runs on this machine (as in tests).  On
    a cluster without the setting no folder would do."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="rasterweave-"))
    return "file://" + _OWN_DIR[0]


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Spark hand texts to Python by at most so many rows at a time.  Its default
    of 10,000 rows keeps tens of megabytes of texts outside the heap in every task,
    twice, and ten times that where texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage,
    survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are over; Spark deletes them when
    the driver collects its garbage, which may else be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a table that stored() made, once nothing reads it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for top in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def keep_fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels must not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def row_hash(df: DataFrame, seed: int) -> Column:
    """64 bits of seed and every column of a row.  Rows that agree in all of
    them are the same row, so an order by this is repeatable after a lost task."""
    def plain(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.to_json(F.struct(c)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else c

    return F.xxhash64(F.lit(seed), *[plain(f) for f in df.schema.fields])
