"""PNM images (P1 to P6): a reader, a writer and a data source named ``pnm``.

Follows the file format: bits of P4 are packed eight a byte and 1 is black (0);
samples above 255 have two bytes, most significant first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")
SCHEMA = "img string, y int, x int, c0 int, c1 int, c2 int"


def decode(data: bytes) -> np.ndarray:
    """height x width x channels of a PNM file; bad files raise ValueError."""
    if len(data) < 2 or data[:1] != b"P" or data[1:2] not in b"123456":
        raise ValueError("not a PNM file")
    kind, at, head = int(data[1:2]), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("a broken PNM header")
        head.append(int(m[1]))
        at = m.end()
    width, height, most = *head[:2], head[2] if len(head) > 2 else 1
    if not (width and height and 0 < most < 65536):
        raise ValueError("a bad PNM size")
    channels = 3 if kind in (3, 6) else 1
    count = width * height * channels
    body = data[at + 1 :]
    if kind == 4:
        rows = np.unpackbits(np.frombuffer(body, np.uint8, height * (-(-width // 8))).reshape(height, -1), axis=1)[:, :width]
        flat = np.where(rows, 0, 255).ravel()
    elif kind == 1:
        digits = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:]), np.uint8)[:count]
        flat = np.where(digits == 49, 0, 255)
    elif kind < 4:
        flat = np.array(re.sub(rb"#[^\n]*", b"", body).split()[:count], dtype=np.int64)
    else:
        flat = np.frombuffer(body, np.uint8 if most < 256 else ">u2", count).astype(np.int64)
    if len(flat) < count:
        raise ValueError("a PNM file that ends early")
    return flat.reshape(height, width, channels).astype(np.int64)


def encode(image: np.ndarray, ascii: bool = False, mono: bool = False) -> bytes:
    """A PNM file of height x width x (1 or 3) numbers."""
    h, w, c = image.shape
    most = 1 if mono else 255 if image.max(initial=0) < 256 else 65535
    kind = (1 if mono else 2 if c == 1 else 3) + (0 if ascii else 3)
    head = f"P{kind}\n{w} {h}\n" + ("" if mono else f"{most}\n")
    if mono:
        bits = (image[:, :, 0] == 0).astype(np.uint8)
        return head.encode() + ("\n".join(" ".join(map(str, r)) for r in bits).encode() + b"\n" if ascii else np.packbits(bits, axis=1).tobytes())
    if ascii:
        return head.encode() + "\n".join(" ".join(map(str, r.ravel())) for r in image).encode() + b"\n"
    return head.encode() + image.astype(np.uint8 if most < 256 else ">u2").tobytes()


def _pixels(img: str, image: np.ndarray) -> pd.DataFrame:
    h, w, c = image.shape
    flat = image.reshape(-1, c).astype(np.int32)
    cols = {f"c{i}": pd.array(flat[:, i] if i < c else [None] * (h * w), "Int32") for i in range(3)}
    return pd.DataFrame({"img": img, "y": np.repeat(np.arange(h, dtype=np.int32), w), "x": np.tile(np.arange(w, dtype=np.int32), h), **cols})


def read_pnm(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of all PNM files under path, by Spark's own file readers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                image = decode(bytes(data))
                for top in range(0, len(image), 256):
                    yield _pixels(name, image[top : top + 256]).assign(y=lambda d, t=top: d["y"] + t)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def encoded(df: DataFrame, ascii: bool = False, mono: bool = False) -> DataFrame:
    """img, content: one PNM file an image (v, or c0, c1, c2)."""
    cols = ["v"] if "v" in df.columns else ["c0", "c1", "c2"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1, len(cols)), np.int64)
        image[pdf["y"], pdf["x"]] = pdf[cols].to_numpy()
        return pd.DataFrame({"img": [pdf["img"].iloc[0]], "content": [encode(image, ascii, mono)]})

    return df.select("img", "y", "x", *cols).groupBy("img").applyInPandas(run, "img string, content binary")


def write_pnm(df: DataFrame, path: str, most: int = 255) -> None:
    """Write each image (img, y, x and v, or c0, c1, c2) as an ASCII PNM file in a
    folder of its own (img=...), with Spark's own text writer, which reaches any
    store.  A task writes whole images, row by row; it holds one row at a time."""
    cols = ["v"] if "v" in df.columns else ["c0", "c1", "c2"]
    value = F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])
    rows = df.groupBy("img", "y").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", value.alias("v")))), lambda p: p["v"]), " ").alias("value"))
    size = df.groupBy("img").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    head = F.concat(F.lit(f"P{2 if len(cols) == 1 else 3}\n"), F.concat_ws(" ", "w", "h"), F.lit(f"\n{most}"))
    lines = rows.unionByName(size.select("img", F.lit(-1).alias("y"), head.alias("value")))
    lines.repartition("img").sortWithinPartitions("img", "y").select("img", "value").write.partitionBy("img").text(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """img, y, x, c0, c1, c2 of the pictures under path that Spark's image source
    can decode (JPEG, PNG, GIF, BMP); grey ones have c0 only.  Channels are put in
    the order red, green, blue."""
    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    n = F.col("nChannels")
    px = image.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)))
    byte = lambda k: F.conv(F.hex(F.expr(f"substring(data, i * nChannels + {k} + 1, 1)")), 16, 10).cast("int")
    rgb = [F.when(n == 1, byte(0) if i == 0 else None).otherwise(byte(2 - i)).alias(f"c{i}") for i in range(3)]
    return px.select(F.col("origin").alias("img"), F.expr("cast(i div width as int)").alias("y"), (F.col("i") % F.col("width")).alias("x"), *rgb)


def from_numpy(spark: SparkSession, img: str, image: np.ndarray) -> DataFrame:
    image = image if image.ndim == 3 else image[:, :, None]
    pdf = _pixels(img, image)
    if image.shape[2] == 1:
        pdf = pdf.rename(columns={"c0": "v"})[["img", "y", "x", "v"]]
        return spark.createDataFrame(pdf, "img string, y int, x int, v int")
    return spark.createDataFrame(pdf, SCHEMA)


def to_numpy(df: DataFrame, img: str) -> np.ndarray:
    """One image on the driver; the caller says that it fits there."""
    cols = ["v"] if "v" in df.columns else ["c0", "c1", "c2"]
    pdf = df.filter(F.col("img") == img).toPandas()
    out = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1, len(cols)), np.int64)
    out[pdf["y"], pdf["x"]] = pdf[cols].to_numpy()
    return out[:, :, 0] if len(cols) == 1 else out


class PnmDataSource(DataSource):
    """spark.read.format("pnm").load(path): files that driver and executors can
    open; read_pnm() reads any store that Spark reads."""

    @classmethod
    def name(cls) -> str:
        return "pnm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        names = [self.path] if os.path.isfile(self.path) else sorted(glob.glob(os.path.join(self.path, "*.p[bgnp]m")))
        return [InputPartition(n) for n in names]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open(partition.value, "rb") as f:
            image = decode(f.read())
        for top in range(0, len(image), 256):
            rows = _pixels(partition.value, image[top : top + 256]).assign(y=lambda d, t=top: (d["y"] + t).astype(np.int32))
            yield from pa.Table.from_pandas(rows, preserve_index=False).to_batches()
