"""Models are judged on rows that they were not fitted on; vectors and components against plain formulas."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.catalog import QUERIES
from larder.fixtures import derived
from larder.operators import classify as cl
from larder.operators.ordering import split_flag
from larder.plans import classification


def accuracy(df, label, pred):
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double"))).first()[0]


@pytest.fixture(scope="module")
def told_apart(spark, sf_dir):
    """The given vectors, moved apart by class: their own labels cannot be told from them."""
    moved = F.transform("embedding", lambda v, i: v + F.when(i == F.col("label"), 0.6).otherwise(0.0))
    df = derived(spark, sf_dir, "embeddings").select("vec_id", moved.cast("array<float>").alias("embedding"), (F.col("label") % 3).cast("string").alias("top"), F.col("label").cast("string").alias("low"))
    df = cl.vectors(df).withColumn("part", split_flag(["vec_id"]))
    return df.where("part = 'train'").drop("part"), df.where("part = 'test'").drop("part")


@pytest.mark.parametrize(("label", "pred", "floor", "scored"), [
    ("top", "p", 0.8, lambda train, test: cl.predict(cl.fit_forest(train, "top", trees=40, depth=8), test, "p")),
    ("top", "p", 0.8, lambda train, test: cl.predict(cl.fit_network(train, "top", [16], 60), test, "p")),
    ("low", "p", 0.9, lambda train, test: cl.Discriminant.fit(train, "low").predict(test, "p")),
    ("low", "low_pred", 0.9, lambda train, test: cl.per_level(train, test, ["top", "low"])),
    ("low", "low_pred", 0.8, lambda train, test: cl.hierarchical(train, test, "top", "low", [])),
], ids=["forest", "network", "discriminant", "per level", "hierarchical"])
def test_held_out_accuracy(told_apart, label, pred, floor, scored):
    train, test = told_apart
    out = scored(train, test)
    assert out.count() == test.count() and accuracy(out, label, pred) >= floor


@pytest.mark.parametrize("name", ["cls01_forest", "cls02_network", "cls03_hierarchical", "cls05_discriminant", "cls06_per_level"])
def test_queries_score_what_they_were_not_fitted_on(spark, sf_dir, name):
    held_out = derived(spark, sf_dir, "embeddings").where(split_flag(["vec_id"]) == "test").select("vec_id")
    got = QUERIES[name](spark, sf_dir).select("vec_id")
    assert sorted(held_out.collect()) == sorted(got.collect())


def test_discriminant_scores(spark, sf_dir):
    """The one-pass fit equals the plain formula on all rows."""
    df = derived(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("low"))
    rows = df.orderBy("vec_id").collect()
    x, y = np.array([r["embedding"] for r in rows], float), np.array([r["low"] for r in rows])
    names = sorted(set(y))
    means = np.array([x[y == c].mean(0) for c in names])
    own = x - means[[names.index(c) for c in y]]
    w = np.linalg.solve(own.T @ own / (len(x) - len(names)), means.T)
    z = x @ w - 0.5 * (means * w.T).sum(1) + np.log([np.mean(y == c) for c in names])
    got = cl.Discriminant.fit(df, "low").predict(df, "p").orderBy("vec_id").collect()
    assert [r["p"] for r in got] == [names[i] for i in z.argmax(1)]
    z = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose([r["p_prob"] for r in got], (z / z.sum(1, keepdims=True)).max(1))


def test_components_explain_the_share(spark, sf_dir):
    df = derived(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out, k = cl.principal_components(df, 0.8)
    rows = out.orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    share = np.cumsum(values[::-1]) / values.sum()
    assert k == np.searchsorted(share, 0.8) + 1 and all(len(r["pca"]) == k for r in rows)
    assert np.allclose(np.abs([r["pca"][0] for r in rows]), np.abs(x @ vectors[:, -1]), atol=1e-5)


def test_nearest_breaks_ties_by_key(spark):
    train = spark.createDataFrame([(i, "b" if i < 3 else "a", [float(i // 6), 0.0]) for i in range(12)], "k long, l string, embedding array<float>")
    asked = spark.createDataFrame([(100, [0.0, 0.0]), (101, [1.0, 0.0])], "k long, embedding array<float>")
    assert {r["k"]: r["prediction"] for r in cl.nearest(train, asked, "k", "l", k=4, rows_per_block=5).collect()} == {100: "b", 101: "a"}


def test_text_vectors_weigh_terms_by_rarity(spark, sf_dir):
    docs = derived(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL")
    n, size = docs.count(), 64
    counts = {}
    for r in docs.collect():
        v = np.zeros(size)
        for w in re.split(r"\s", r["text"].lower()):
            v[int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % size] += 1
        counts[r["doc_id"]] = v
    idf = np.log((n + 1) / (sum((v > 0).astype(int) for v in counts.values()) + 1))
    for r in cl.text_vectors(docs, "text", size).limit(40).collect():
        assert math.isclose(np.abs(r["features"].toArray() - counts[r["doc_id"]] * idf).max(), 0, abs_tol=1e-6)
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r["features"].numNonzeros() for r in cl.text_vectors(odd, "text", size).collect()] == [0, 0]


def test_stored_models_predict_as_fitted_ones(spark, told_apart, tmp_path):
    train, test = told_apart
    fitted = cl.Levels.fit(train, "top", "low", ["2"])
    fitted.save(spark, str(tmp_path / "models"))
    loaded = cl.Levels.load(spark, str(tmp_path / "models"))
    assert sorted(loaded.low) == ["0", "1"]
    a, b = (m.predict(test, "top", "low").select("vec_id", "top_pred", "low_pred", "top_pred_prob", "low_pred_prob").collect() for m in (fitted, loaded))
    assert sorted(a) == sorted(b)
    assert all(r["low_pred"] == "2" and r["low_pred_prob"] is None for r in a if r["top_pred"] == "2")
    # a lower model equals one fitted on the rows of its class alone
    alone = cl.Discriminant.fit(train.where("top = '1'"), "low")
    assert alone.names == fitted.low["1"].names and np.allclose(alone.weights, fitted.low["1"].weights)


def test_classification_flow(spark, told_apart, tmp_path):
    train, test = told_apart
    named = lambda df: df.select("vec_id", "embedding", F.col("top").alias("parent"), F.concat(F.lit("main "), F.col("low").cast("int") % 2).alias("main"), F.col("low").alias("sub"))
    labelled, path = named(train), str(tmp_path / "models")
    metrics, covered = classification.held_out(named(train.union(test)), "vec_id", path, ["2"])
    assert metrics.where("level = 'parent'").first()["accuracy"] >= 0.8
    assert 0 < covered.first()["confident"] <= covered.first()["n"]
    classification.store_models(labelled, path, ["2"])
    asked = test.select("vec_id", "embedding").union(spark.createDataFrame([(-1, None)], "vec_id long, embedding array<float>"))
    rows = {r["vec_id"]: r for r in classification.predictions(asked, labelled, path).collect()}
    assert len(rows) == test.count() + 1
    none = rows.pop(-1)
    assert none["parent"] is None and none["main"] is None and not none["confident"]
    for r in rows.values():
        assert r["main"] == ("2" if r["parent"] == "2" else f"main {int(r['sub']) % 2}")
        assert r["confident"] == (r["parent_prob"] > 0.8 and (r["sub_prob"] is None or r["sub_prob"] > 0.8))
