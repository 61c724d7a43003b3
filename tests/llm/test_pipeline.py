"""The pipeline, each stage against what its operator says of the same input."""

from collections import Counter

import corpus_pipeline
from cohortwave.llm import decontamination, near_dedup


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}")
        at[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = at[name][1]
        assert set(columns) <= set(docs.columns)
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    before, after = at["near_dedup"]
    assert ids(after) == Counter({r.component_id: 1 for r in near_dedup.near_duplicates(before).select("component_id").distinct().collect()})
    before, after = at["decontamination"]
    found = decontamination.contaminated(before, spark.read.parquet(f"{small}/benchmark.parquet"))
    assert set(ids(before)) - set(ids(after)) == {r.doc_id for r in found.collect()}
    before, after = at["mixing"]
    assert set(ids(after)) <= set(ids(before)) and max(ids(after).values()) <= 2
    before, after = at["sharding"]
    assert ids(before) == ids(after)
    assert set(r.shard for r in after.collect()) <= set(range(40))


def test_run_gives_the_last_stage(spark, small):
    whole = corpus_pipeline.run(spark, small)
    assert {"doc_id", "text", "lang", "source", "n_chars", "size", "text_crc32", "shard", "slot"} == set(whole.columns)
    assert whole.count() > 0
