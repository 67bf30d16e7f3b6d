"""Rows of one task stay bounded when tables grow."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import fixtures
from larder.catalog import QUERIES
from larder.operators import classify, compose, language, relational
from larder.plans import ingest


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_a_task_stay_bounded(spark, sf_dir, monkeypatch):
    """lists are made in as many tasks as their lines take, with the same rows."""
    names = ["agg22_two_step", "agg13_proportions", "win06_monotone_repair"]
    want = {n: sorted(map(tuple, QUERIES[n](spark, sf_dir).collect())) for n in names}
    before = fixtures.derived(spark, sf_dir, "ing")
    monkeypatch.setattr(fixtures, "LINES_A_TASK", 300)
    dealt = fixtures.derived(spark, sf_dir, "ing")
    assert "REPARTITION_BY_NUM" not in plan(before) and "REPARTITION_BY_NUM" in plan(dealt)
    tasks = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 18 and max(r["count"] for r in tasks) < 600
    for n in names:
        assert sorted(map(tuple, QUERIES[n](spark, sf_dir).collect())) == want[n]


def test_joins_keep_the_number_of_tasks(spark, sf_dir, monkeypatch):
    """the join with the parts takes as many tasks too, where parts are too large to be broadcast."""
    monkeypatch.setattr(fixtures, "LINES_A_TASK", 300)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = plan(fixtures.derived(spark, sf_dir, "ing"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in shown.splitlines() if "hashpartitioning(l_partkey" in line or "hashpartitioning(p_partkey" in line]
    assert len(joins) == 2 and all(", 20)," in line for line in joins), joins


def test_groups_are_brought_to_the_cells(spark, monkeypatch):
    """cells are not shuffled for each small table of groups; with many groups they are, with the same result."""
    rows = [(i, 1 + i % 6, f"r{i % 2}", "d", f"a{i % 3}", None if i % 5 == 0 else f"s{i % 4}", f"c{i % 3}" if i % 7 else None, None if i % 4 == 0 else 40.0 / (1 + i % 6) + i % 3) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, pos int, retailer string, department string, aisle string, shelf string, food_category string, percent0 double")
    df = compose.printed_share(df.withColumns({"food_category_sub": F.concat("food_category", F.lit("x")), "food_category_sub_sub": F.lit(None).cast("string")}))
    df = compose.adaptive_categories(df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, shuffles = [], []
        for rows_at_most in (200_000, 0):
            monkeypatch.setattr(relational, "BROADCAST_ROWS", rows_at_most)
            candidates = compose.candidate_table(df, compose.cells_of(df))
            chosen = compose.choose_estimates(df, candidates)
            shuffles.append(plan(chosen).count("SortMergeJoin"))
            found.append(sorted((tuple(r) for r in chosen.collect()), key=repr))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffles == [0, 9] and found[0] == found[1] and any(r[-1] is not None for r in found[0])


def test_frequent_words_are_not_shuffled(spark, monkeypatch):
    """only rare words go through the shuffle, and languages are the same whatever is frequent."""
    texts = [("the red house", "en"), ("the the old house", "en"), ("das alte haus", "de"), ("das haus der frau", "de"), ("qzx", "de"), ("", "en"), (None, "de"), ("x", "en"), ("123", None), ("the das", None)]
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(texts)], "id long, text string, lang string")
    profile = language.word_profile(df.where("lang IS NOT NULL"), "text", "lang")
    want = {0: "en", 1: "en", 2: "de", 3: "de", 4: "de", 5: "und", 6: "und", 7: "und", 8: "und"}
    for words in (1, 8, 200_000):
        monkeypatch.setattr(language, "FREQUENT_WORDS", words)
        out = language.detect_language(df, "text", "id", profile)
        assert "BroadcastHashJoin" in plan(out) and "LeftAnti" in plan(out)
        got = {r["id"]: r["language"] for r in out.collect()}
        assert got.pop(9) in ("en", "de") and got == want


def test_texts_are_not_shuffled_for_their_language(spark):
    """counting routes doesn't carry the texts through the last join."""
    df = spark.createDataFrame([(f"Name {i % 5}", "the red house" if i % 3 else "", "en,fr") for i in range(60)], "product_name string, ingredients_text string, countries string")
    labelled = spark.createDataFrame([("the red house name", "en"), ("das alte haus", "de")], "text string, lang string")
    out = ingest.open_products(df, language.word_profile(labelled, "text", "lang"), 10)
    assert out.columns[-1] == "route" and not [c for c in out.columns if c.startswith("__")]
    counted = out.groupBy("country", "route").count()
    joins = [line for line in counted._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line]
    assert joins and {(r["country"], r["route"]): r["count"] for r in counted.collect()} == {("en", "eng"): 10, ("fr", "eng"): 10}
    top = counted._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[0]
    assert "ingredients_text" not in top


def test_few_distances_are_held(spark, monkeypatch):
    """the matrix of distances is bounded by its cells, with the same neighbours."""
    rows = [(i, [float(i * 7 % 31), float(i * 5 % 17), float(i % 3)], f"l{i % 4}") for i in range(300)]
    df = spark.createDataFrame(rows, "k long, embedding array<float>, label string")
    train, test = df.where("k % 5 <> 0"), df.where("k % 5 = 0")
    want = {r["k"]: r["prediction"] for r in classify.nearest(train, test, "k", "label").collect()}
    monkeypatch.setattr(classify, "DISTANCES", 700)
    assert {r["k"]: r["prediction"] for r in classify.nearest(train, test, "k", "label").collect()} == want and len(want) == 60
