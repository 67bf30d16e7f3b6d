"""Checkpoints of wide tables as compressed columns, and categories brought to the items."""

from __future__ import annotations

import os

from larder.operators import relational
from larder.plans import composition as pc
from larder.session import compact_checkpoint

COLUMNS = "id long, product_name string, retailer string, country string, department string, aisle string, shelf string, ingredients_text string"
ROWS = [(i, f"product {i}", "shop of all things", "land", "fresh food", "aisle one", None if i % 3 else "low", t) for i, t in enumerate(["red rod 40%, bolt (steel, zinc 2%), gear", "bolt, ring", None, "ring 12%, unknown (bolt), rod"] * 3)]


def test_rows_stay_and_keys_are_stored_once(spark):
    df = spark.range(40_000).selectExpr("id", "repeat('a long key ', 20) AS key", "CASE WHEN id % 2 = 0 THEN 1.5 END AS x", "CAST(NULL AS STRING) AS none")
    kept = compact_checkpoint(df)
    assert kept.dtypes == df.dtypes and kept.exceptAll(df).count() == 0 and kept.count() == 40_000
    sizes = [os.path.getsize(f.removeprefix("file://")) for f in kept.inputFiles()]
    assert sizes and sum(sizes) < 40_000 * 220 / 10


def test_few_categories_are_brought_to_the_items(spark, monkeypatch):
    words = [("Rings", ["ring"]), ("Bolts", ["bolt"]), ("Tools", ["gear"])]
    found = lambda: pc.known_ingredients(spark.createDataFrame(ROWS, COLUMNS), words, [], [])
    top = lambda df: df._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    few = found()
    assert "strategy=broadcast" in top(few)
    monkeypatch.setattr(relational, "BROADCAST_ROWS", 0)
    many = found()
    assert "strategy=broadcast" not in top(many)
    assert few.count() == many.count() > 20 and few.exceptAll(many).count() == 0
