"""The stages one after another, each against what its operator says."""

from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import bpe, jaccard, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_copies", "secrets", "mixing", "tokens"]
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"))
    good = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").select("row.doc_id").collect()}
    one = corpus_pipeline.quality_stage(spark, docs, SF).persist()
    assert {r.doc_id for r in one.collect()} == good and one.columns == docs.columns
    two = corpus_pipeline.near_copies_stage(spark, one, SF).persist()
    assert {r.doc_id for r in two.collect()} == {r.component_id for r in jaccard.jaccard_components(one).collect()}
    three = corpus_pipeline.secrets_stage(spark, two, SF).persist()
    assert three.columns == docs.columns and three.count() == two.count() and three.where(
        "n_chars <> length(text)"
    ).count() == 0
    four = corpus_pipeline.mixing_stage(spark, three, SF).persist()
    assert four.columns == docs.columns
    words = lambda d: d.select(
        F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    ).first()[0]
    assert abs(words(four) - 1.5 * words(three)) <= 2 * three.select("source").distinct().count()
    codec = bpe.Codec(bpe.word_model())
    want = sorted((r.doc_id, *codec.digest(r.text)) for r in four.collect())
    assert sorted(tuple(r) for r in corpus_pipeline.tokens_stage(spark, four, SF).collect()) == want
