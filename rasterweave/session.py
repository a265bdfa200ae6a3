"""Session helpers: where intermediate tables go, and how they are cut off."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and all
    runs on this machine; on a cluster there is no such folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="rasterweave-raster-"))
    return "file://" + _OWN[0]


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that loops keep short
    plans and lost executors cost no recomputation of earlier rounds."""
    path = f"{shared_dir(df.sparkSession)}/raster-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
