"""The pipeline's stages keep their promises on a small table."""

import corpus_pipeline
from morphogrid.llm import fm_decontam, registry
from morphogrid.llm.common import default_spec

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        now = [r.doc_id for r in docs.collect()]
        assert docs.columns == columns and len(now) == len(set(now)) and set(now) <= seen, name
        seen = set(now)
    marked = fm_decontam.digest(fm_decontam.mark_benchmark(docs, spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert marked.where("n_hit > 0").count() == 0
    assert docs.where("n_chars <> length(text)").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == seen
    assert len(default_spec()) > 1000


def test_registered():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert [n for n in registry.queries() if n.startswith("op")] == sorted((n for n in registry.queries() if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
