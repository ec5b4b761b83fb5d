"""The pipeline's stages, each on its own input."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = docs.columns
    kept = pipeline.quality(spark, docs, SF)
    assert kept.columns == names
    good = labels.where("quality = 1 and toxic = 0")
    assert kept.join(good, "doc_id", "left_semi").count() > 0.97 * docs.join(good, "doc_id", "left_semi").count()
    once = pipeline.near_dedup(spark, docs, SF)
    assert once.columns == names and once.count() == once.select("doc_id").distinct().count()
    assert once.select("text").distinct().count() == once.count()
    from netquill.llm import winnow

    clean = pipeline.decontaminate(spark, docs, SF)
    assert clean.columns == names
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert winnow.contamination(clean, bench).where("n_hit > 0").count() == 0
    dirty = winnow.contamination(docs, bench).where("n_hit > 0").count()
    assert clean.count() == docs.count() - dirty and dirty > 0
    mixed = pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == names and 1.2 < mixed.agg(F.sum("n_chars")).first()[0] / docs.agg(F.sum("n_chars")).first()[0] < 1.8
    sharded = pipeline.shard(spark, docs, SF)
    assert sharded.columns == [*names, "shard"] and sharded.count() == docs.count()


def test_repeated_and_null_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, None, None, None, None), (None, "some text that is only here", "en", "src0", 1), (7_000_001, "", "en", None, 0)], docs.schema))
    once = pipeline.near_dedup(spark, odd, SF)
    assert once.groupBy("doc_id", "text").count().where("count > 1").count() == 0
    for _, stage in pipeline.STAGES:
        stage(spark, odd, SF).count()
        stage(spark, docs.where("false"), SF).count()
