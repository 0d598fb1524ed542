"""The stages one after another on the smallest tables, and odd rows through each of them."""

import corpus_pipeline as P
import pytest

from factorlake.llm import toxicity
from factorlake.session import materialize


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 4 <= len(P.STAGES) <= 5
    columns, before = docs.columns, docs.count()
    for name, stage in P.STAGES:
        out = materialize(stage(spark, docs, sf))
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}
            break
        assert out.columns == columns and 0 < out.count() <= before
        docs, before = out, out.count()
    assert before < spark.read.parquet(f"{sf}/documents.parquet").count()


def test_run(spark, sf):
    pieces = P.run(spark, sf)
    assert pieces.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_odd_rows(spark, sf, odd_docs, no_docs, name):
    stage = dict(P.STAGES)[name]
    out = stage(spark, odd_docs, sf)
    assert out.columns == odd_docs.columns or name == "packing"
    assert out.count() <= odd_docs.count() or name == "packing"
    assert stage(spark, no_docs, sf).count() == 0


def test_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = P.toxicity_filter(spark, docs, sf).select("doc_id")
    marked = labels.where("toxic = 0")
    assert marked.join(kept, "doc_id").count() > 0.98 * marked.join(docs, "doc_id").count()
    assert toxicity.THRESHOLD == 0.7
