from pyspark.sql import functions as F

import corpus_pipeline
from modeflow.llm import exact, minhash, packing, toxicity


def test_stages(spark, sf, odd_docs, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert docs.columns == names and docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "toxicity":
            model = toxicity.learn(toxicity.labelled_rows(before, spark.read.parquet(f"{sf}/labels.parquet"), ~corpus_pipeline.held_out(4, 2)))
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect() if model.score(r["text"] or "") < 0.3}
        if name == "exact_dedup":
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in exact.exact_groups(before).where("kept").collect()}
        if name == "near_dedup":
            assert {r["doc_id"] for r in docs.collect()} == {r["id"] for r in minhash.near_groups(before).where("id = component_id").collect()}
        if name == "packing":
            assert set(docs.columns) >= {"sequence_id", "offset", "ids_crc32"} and {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}
    assert corpus_pipeline.run(spark, sf).agg(F.sum("length")).first()[0] == docs.agg(F.sum("length")).first()[0]


def test_empty_corpus(spark, no_docs, sf):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0 and packing.TIERS[0] == 2048
