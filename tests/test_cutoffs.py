"""Cut-offs on sums of doubles don't depend on the order of the rows."""

from __future__ import annotations

import functools
import itertools
import operator

from pyspark.sql import functions as F

from larder.catalog import QUERIES
from larder.fixtures import derived
from larder.operators import impacts as im


def test_identified_whatever_the_order(spark):
    """Shares that add up to 75 exactly stay in every order, though sums of doubles fall on either side of it."""
    shares = [100 * k / 376 for k in (58, 35, 93, 30, 66)]
    sums = {functools.reduce(operator.add, p) for p in itertools.permutations(shares)}
    assert min(sums) < 75 < max(sums)
    rows = [(i, "a", x) for i, p in enumerate(itertools.permutations(shares)) for x in p] + [(900, "a", 74.999999), (901, None, 80.0)]
    df = spark.createDataFrame(rows, "id long, food_category string, percent double")
    for parts in (1, 13):
        assert {r["id"] for r in im.identified(df.repartition(parts), ["id"]).collect()} == set(range(120))


def test_nut03_after_another_distribution(spark, sf_dir):
    i = derived(spark, sf_dir, "ing").withColumn("percent", F.col("true_percent")).withColumn("food_category", F.when(F.col("food_category") != "SMALL", F.col("food_category")))
    want = {r["id"] for r in QUERIES["nut03_identified"](spark, sf_dir).collect()}
    for parts in (3, 13):
        assert {r["id"] for r in im.identified(i.repartition(parts, F.rand(parts)), ["id"]).collect()} == want
