"""Patterns run once a text or once a distinct name, trials stay in their tasks, and a few ranks move no rows."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.catalog import QUERIES
from larder.functions import cleaning, labels
from larder.functions.steps import FASTER, rewrite
from larder.operators import compose, matching, solver
from larder.operators.lists import hidden_positions
from larder.operators.relational import first_filled
from larder.operators.summaries import supported_mean
from larder.plans import composition, ingest

ODD = [
    "", " ", "  a   b ", "flour (wheat, salt) (12%), sugar", "a b  (c) (3.5%)", "(12%) oats, x", "a(b)(c)(1%)", "(b) (2%)", "a, (b) (2%)", "a\n (b)\t(20.25%)", "x )y (z) (4%) w(v)(5%)", "aa (b) (c) (1%)",
    "may contain nuts", "sugar. it may contain egg\nnext may contain", "allergens: x", "ma y contain", "made in", "my method our method", "salt from organic farming", None, "é (ü) (7%)", "a (12%) (b) (13%)",
]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_faster_patterns_give_the_same(spark):
    """F16: what Java reads faster replaces the same."""
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    assert len(FASTER) >= 4
    for (pattern, new), fast in FASTER.items():
        both = df.select("t", F.regexp_replace("t", F.lit(pattern), F.lit(new)).alias("a"), rewrite(F.col("t"), [("re", pattern, new)]).alias("b"))
        assert [r for r in both.collect() if r["a"] != r["b"]] == [] and fast != pattern


def test_structure_names_its_text_once(spark):
    """F16: the cleaning before it isn't repeated, and NULL stays NULL."""
    assert len(re.findall("the_text", str(cleaning.correct_structure(F.col("the_text"))))) == 1
    df = spark.createDataFrame([(None,), ("(12%) oats",)], "t string")
    assert [r[0] for r in df.select(cleaning.correct_structure(F.col("t"))).collect()] == [None, "oats (12%)"]


def test_open_texts_are_cleaned_once(spark):
    """neither the filter on usable characters nor the steps behind it repeat the cleaning."""
    df = spark.createDataFrame([(1, "Sugar - salt"), (2, "café: x"), (3, None)], "id int, t string")
    out = ingest.cleaned_open(df, "t")
    assert plan(out).count("rainforest alliance") <= 2  # the faster pattern names the phrase once; a generator may print itself twice
    assert {r["id"]: r["t"] for r in out.collect()} == {1: "sugar, salt", 3: ""}


def test_nutrients_are_read_once():
    """the steps of a nutrient bind each other's result, so a label's patterns stand there a few times and not by the power."""
    assert str(labels.nutrient(F.col("a_label"), energy=True)).count("a_label") <= 5


def test_names_are_matched_once(spark):
    """a filter on the category doesn't repeat the patterns that found it, and rows get their own name's category."""
    rows = [
        (1, "butter", "r", "d", 1, "minimum 82% fat"), (2, "bread", "r", "d", 1, "minimum 82% fat"), (3, None, "r", "d", 2, "yeast"), (4, "x", "r", "d", 1, "yeast"), (5, "x", "r", None, None, "yeast"),
        (6, "x", "r", "d", 3, "red ring"), (7, "x", "s", "d", 3, "ring of bolt"), (8, "x", "s", "d", 4, "bolt"), (9, "x", "s", "d", 4, None), (10, "x", "s", "d", 5, "sea salt"), (6, "x", "r", "d", 3, "red ring"),
    ]
    df = spark.createDataFrame([(*r, "") for r in rows], "id int, product_name string, retailer string, department string, pos int, name string, embedded string")
    subs = [("Rings", "Red", "red", 1), ("Rings", "Other", None, 2)]
    out = composition.categorised(df, [("Rings", ["ring"]), ("Bolts", ["bolt"])], subs, [], "name")
    eligible = out.where(matching.embedded_eligible(F.col("food_category"), F.col("name"), F.lit("a, b")))
    assert plan(eligible).count("psyllium") <= 2
    got = {r["id"]: (r["food_category"], r["food_category_sub"]) for r in out.collect()}
    assert out.count() == len(rows) and got == {
        1: ("Butter, Cream & Ghee", None), 2: (None, None), 3: ("Other Food Additive", None), 4: (None, None), 5: (None, None), 6: ("Rings", "Red"), 7: ("Rings", "Other"), 8: ("Bolts", None),
        9: (None, None), 10: ("Salt", None),
    }


def _trials(items, at_most):
    """The hidden check with a row for each place of each trial."""
    items = compose.printed_share(items)
    lengths = items.groupBy("id").agg(F.count("*").cast("int").alias("n"), F.count("percent").alias("known"))
    full = lengths.where((F.col("known") == F.col("n")) & (F.col("n") >= 2)).select("id", "n")
    trials = full.join(hidden_positions(items.sparkSession, full.agg(F.max("n")).first()[0], at_most), "n").join(items, "id")
    gone = F.array_contains("hidden", F.col("pos"))
    trials = trials.withColumn("truth", F.col("percent")).withColumn("percent", F.when(~gone, F.col("percent"))).withColumn("keep", ~gone)
    tables = []
    for keys in (["aisle", "shelf"], ["aisle"], ["department"]):
        t = supported_mean(items, [*keys, "food_category"], "pos", "percent", 10, count_all=True, strictly_more=True)
        tables.append((t.where("food_category IS NOT NULL").withColumnRenamed("mean_percent", "percent"), [*keys, "food_category", "pos"]))
    trials = first_filled(trials, tables, "percent")
    out = solver.solve_lists(trials.select("id", "n", "k", "combo", "pos", "percent", "keep", "truth"), ["id", "n", "k", "combo"], value=None)
    out = out.where("NOT keep").groupBy("n", "k").agg(F.count("*").alias("hidden"), F.avg(F.abs(F.col("percent") - F.col("truth"))).alias("mean_error"), F.avg(F.col("converged").cast("double")).alias("converged"))
    return {(r["n"], r["k"]): (r["hidden"], r["mean_error"], r["converged"]) for r in out.collect()}


def test_hidden_check_makes_no_trial_rows(spark):
    """the same figures as a row for each place of each trial gives, without those rows."""
    rows = []
    for i in range(160):
        n = 1 + i % 7
        for p in range(1, n + 1):
            share = 100 * (n + 1 - p) / (n * (n + 1) / 2)
            rows.append((None if i == 14 else i, p + (i == 20), f"c{p % 3}" if i % 5 else None, f"a{i % 2}", f"s{i % 3}", None if i % 11 == 0 else "d", None if i == 30 and p == 2 else share - i % 3 / 4))
    df = spark.createDataFrame(rows, "id long, pos int, food_category string, aisle string, shelf string, department string, percent0 double")
    out = composition.hidden_check(df, at_most=6)
    got = {(r["n"], r["k"]): (r["hidden"], r["mean_error"], r["converged"]) for r in out.collect()}
    want = _trials(df, 6)
    assert set(got) == set(want) and len(got) == 21
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)
    assert "MapInArrow" in plan(out) and "combo" not in plan(out)
    assert {r["n"] for r in composition.hidden_check(df, max_items=4).collect()} == {2, 3, 4}


def test_ranks_are_brought_to_the_rows(spark, sf_dir):
    """rows don't go by the name of their column, of which there are four."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "strategy=broadcast" in plan(QUERIES["agg16_sketched_profile"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_errors_round_as_in_wider_tables():
    """whether longer lists are solved beside it doesn't change a list's errors."""
    rng = np.random.default_rng(1)
    q = np.sort(rng.integers(1, 51, (600, 7)), axis=1)[:, ::-1].astype(float)
    truth = np.repeat(50 * q / q.sum(1, keepdims=True), 2, axis=1)
    estimate = np.repeat(rng.choice([np.nan, 7.1, 12.3, 20.7, 33.3], (600, 7)), 2, axis=1)
    gone = rng.random((9, 600, 14)) < 0.6
    p, keep = (np.pad(x.reshape(-1, 14), ((0, 0), (0, 14)), constant_values=v) for x, v in ((np.where(gone, estimate, truth), np.nan), (~gone, False)))
    wide = solver.fill_to_100(p, keep, np.full(len(p), 14), np.full(len(p), -1))[:, :14]
    error = np.abs(wide - np.broadcast_to(truth, gone.shape).reshape(-1, 14))[gone.reshape(-1, 14)]
    assert solver._errors(gone, truth, estimate)[2] == error[~np.isnan(error)].sum()
