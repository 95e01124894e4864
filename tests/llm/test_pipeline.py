"""The pipeline's stages against what each operator says on its own input."""

import corpus_pipeline
from panelmill.llm import exact_dedup, ngram_join, packing, quality, toxicity
from panelmill.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages(spark, tmp_path):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    want = [
        lambda d: d.join(quality.score(d, quality.train(d, labels)).where("predicted = 1"), "doc_id", "left_semi"),
        lambda d: d.join(toxicity.score(d, toxicity.train(d, labels)).where("predicted = 0"), "doc_id", "left_semi"),
        lambda d: d.join(exact_dedup.exact_dedup(d).where("kept"), "doc_id", "left_semi"),
        lambda d: d.join(ngram_join.ngram_components(d, 5, 4, 5).where("doc_id = component_id"), "doc_id", "left_semi"),
    ]
    assert len(corpus_pipeline.STAGES) == 5
    for k, (expected, (name, stage)) in enumerate(zip(want, corpus_pipeline.STAGES, strict=False)):
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        assert ids(kept) == ids(expected(docs)), name
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.selectExpr("sum(length)").first()[0] == packing.pack(docs).selectExpr("sum(length)").first()[0]
    assert sorted({r[0] for r in packed.select("doc_id").collect()}) == ids(docs)
