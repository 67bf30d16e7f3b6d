"""Registered corpus queries against their SQL, and the pipeline against its stages' laws."""

from __future__ import annotations

import pytest

import corpus_pipeline
from larder.llm import catalog
from tests import compare


@pytest.mark.parametrize("name", sorted(catalog.CHECKS))
def test_query_equals_its_sql(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(compare, "QUERIES", catalog.QUERIES)
    monkeypatch.setattr(compare, "CHECKS", catalog.CHECKS)
    assert compare.difference(spark, compare.duck(sf_dir), sf_dir, name) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.CHECKS)))
def test_query_covers_all_documents(spark, sf_dir, name):
    docs = {r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in catalog.QUERIES[name](spark, sf_dir).collect()} == docs


def test_pipeline(spark, sf_dir):
    docs = catalog.table(spark, sf_dir, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen.append(corpus_pipeline.stored(out, name))
    raw, good, exact, near, mix, last = seen
    assert raw.count() > good.count() > exact.count() >= near.count()
    assert exact.selectExpr("count(distinct translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) = count(*)").first()[0]
    assert mix.select("doc_id").distinct().join(near, "doc_id", "left_anti").isEmpty() and mix.count() == last.count()
    assert last.join(near.withColumnRenamed("text", "before"), "doc_id").where("text <> before").isEmpty()
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, run.collect())) == sorted(map(str, last.collect()))
