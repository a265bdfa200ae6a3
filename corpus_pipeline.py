"""From documents to training shards: five stages of rasterweave.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; run() writes each result as Parquet to the shared folder and reads it
again.  Toxic documents go, one document of each near-duplicate group stays, and
documents with leaked test items go; the mix repeats or leaves out documents by
their source's target; the last stage deals what is left into eight shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.llm import decontaminate, jaccard, mixing, sharding, toxicity
from rasterweave.llm.common import bounded_batches, held_out, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels, ~held_out(F.col("doc_id")))
    return toxicity.score_toxicity(docs, model).filter("tox_score < 0.7").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(docs, 8)


STAGES = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_leaks),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

#: A trained classifier is no SQL; tests/llm checks the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "pipeline")
    return docs
