"""Rasters derived from the driver's tables: one row a pixel.

Columns: img, y, x and v, or c0, c1, c2 for colour; ev_video has frame as well.
Each has the same definition as SQL (a list of common table expressions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clip(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("int")


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("emb").alias("img"), F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "e")).withColumn("e", F.col("e").cast("double"))


def emb_grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir).select("img", "y", "x", clip(F.floor((F.col("e") + 0.6) * 200)).alias("v"))


def emb_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = F.expr("(x div 16 + y div 16) % 2 * 120")
    return _elements(spark, sf_dir).select("img", "y", "x", clip(board + F.floor((F.col("e") + 0.6) * 60)).alias("v"))


def _channels(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.lit("emb").alias("img"), F.col("vec_id").cast("int").alias("y"), "embedding")
    e = e.withColumn("x", F.explode(F.sequence(F.lit(0), F.expr(f"cast(size(embedding) div {step} - 1 as int)"))))
    value = lambda i: clip(F.floor((F.element_at("embedding", F.col("x") * step + 1 + i).cast("double") + 0.6) * 200))
    return e.select("img", "y", "x", *[value(i).alias(f"c{i}") for i in range(step)])


def emb_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _channels(spark, sf_dir, 3)


def emb_uyvy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _channels(spark, sf_dir, 2)


def ev_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    cells = ev.groupBy(day.alias("frame"), F.hour("ts").alias("y"), (F.col("user_id") % 32).cast("int").alias("x")).agg(F.least(F.lit(255), F.sum(F.floor("value").cast("int"))).cast("int").alias("v"))
    return cells.select(F.lit("ev").alias("img"), "frame", "y", "x", "v")


def doc_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every character of every text, one row of pixels a document."""
    docs = table(spark, sf_dir, "documents").select(F.lit("doc").alias("img"), F.col("doc_id").cast("int").alias("y"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "")).alias("x", "char"))
    return docs.filter("char != ''").select("img", "y", "x", F.least(F.lit(255), F.ascii("char")).cast("int").alias("v"))


_ELEMENTS = "el AS (SELECT vec_id::INT AS y, generate_subscripts(embedding, 1)::INT - 1 AS x, unnest(embedding)::DOUBLE AS e FROM embeddings)"


def _sql_channels(step: int) -> str:
    cols = ", ".join(f"greatest(0, least(255, floor((embedding[x * {step} + {i + 1}]::DOUBLE + 0.6) * 200)))::INT AS c{i}" for i in range(step))
    return f"px AS (SELECT y, x, {cols} FROM (SELECT vec_id::INT AS y, embedding, unnest(range(len(embedding) // {step}))::INT AS x FROM embeddings))"


SQL = {
    "emb_grey": _ELEMENTS + ", px AS (SELECT y, x, greatest(0, least(255, floor((e + 0.6) * 200)))::INT AS v FROM el)",
    "emb_check": _ELEMENTS + ", px AS (SELECT y, x, greatest(0, least(255, (x // 16 + y // 16) % 2 * 120 + floor((e + 0.6) * 60)))::INT AS v FROM el)",
    "emb_rgb": _sql_channels(3),
    "emb_uyvy": _sql_channels(2),
    "ev_video": "px AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS frame, hour(ts)::INT AS y, (user_id % 32)::INT AS x, least(255, sum(floor(value)::INT))::INT AS v FROM events GROUP BY ALL)",
    "doc_bytes": "px AS (SELECT y, x, least(255, unicode(ch))::INT AS v FROM (SELECT doc_id::INT AS y, generate_subscripts(string_split(text, ''), 1)::INT - 1 AS x, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''))",
}
