"""The pipeline's stages one after another on the smallest tables."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from rasterweave.llm import decontaminate, jaccard
from rasterweave.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        kept.append(docs)
    start, clean, single, unleaked, mixed = kept
    labels = spark.read.parquet(f"{SF}/labels.parquet").join(start.select("doc_id"), "doc_id")
    gone = start.join(clean, "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.filter("toxic = 0").count() <= 3
    assert jaccard.jaccard_components(single).filter("doc_id != component_id").count() == 0
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.contaminated(unleaked, bench).count() == 0 and unleaked.count() > 0.8 * single.count()
    times = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert set(times.values()) <= {1, 2} and set(times) <= {r["doc_id"] for r in unleaked.select("doc_id").collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, mixed, SF)
    count = [r["count"] for r in last.groupBy("shard").count().collect()]
    assert last.count() == mixed.count() and max(count) - min(count) <= 1
    assert last.agg(F.countDistinct("shard", "slot")).first()[0] == mixed.count()
