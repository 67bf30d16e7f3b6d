"""Nothing is cut: long lists, fractional weights, resumed writes, series that don't settle."""

import math

import pytest
from pyspark.sql import functions as F

from larder.functions.nested import parse_list
from larder.operators import lists, montecarlo, reexport, solver
from larder.sources import sinks


def test_a_long_list_comes_back_whole(spark):
    inner = ", ".join(f"inner {j}" for j in range(40))
    text = ", ".join(f"item {i} ({inner})" if i % 6 == 0 else f"item {i}" for i in range(120))
    items = spark.createDataFrame([(text,)], "t string").select(parse_list(F.col("t")).alias("x")).first()["x"]
    assert [x["value"] for x in items] == [f"item {i}" for i in range(120)]
    assert [x["embedded"] for x in items if x["embedded"]] == [inner] * 20


def test_a_long_list_adds_up_to_100(spark):
    rows = [(1, i, f"item {i}", None, False) for i in range(1, 121)] + [(2, 1, "water", 60.0, True), (2, 2, "oil", None, False)]
    out = solver.solve_lists(spark.createDataFrame(rows, "id int, pos int, value string, percent double, keep boolean"), ["id"]).collect()
    assert sum(r["id"] == 1 for r in out) == 120
    for i in (1, 2):
        assert sum(r["percent"] for r in out if r["id"] == i) == pytest.approx(100, abs=0.5)


def test_fractional_weights_keep_their_ratio(spark):
    columns = ["food_category", "food_category_sub", "food_category_sub_sub"]
    schema = "obs_id long, weight double, " + ", ".join(f"{c} string" for c in columns) + ", " + ", ".join(f"{i} double" for i in montecarlo.INDICATORS)
    rows = [(i, w, "Rice", None, None, *[1.0] * len(montecarlo.INDICATORS)) for i, w in ((1, 0.04), (2, 0.16))]
    units = {r["obs_id"]: r["units"] for r in montecarlo.prepared(spark.createDataFrame(rows, schema)).collect()}
    assert units[1] * 26 == units[2] * 14


def test_a_half_written_partition_is_written_again(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, k string")
    rows.where("id = 1").write.mode("append").partitionBy("k").parquet(path)  # a run that failed before it was marked
    sinks.write_pending(rows, path, ["k"])
    sinks.write_pending(rows.withColumn("id", F.lit(9)), path, ["k"])  # all is complete by now
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_a_series_that_does_not_settle_is_an_error(spark):
    production = spark.createDataFrame([("x", i, 100.0) for i in "abc"], "item string, iso3 string, production double")
    edges = spark.createDataFrame([("x", "a", "b", 90.0), ("x", "b", "c", 150.0), ("x", "c", "a", 200.0)], "item string, exporter string, importer string, qty double")
    with pytest.raises(RuntimeError):
        reexport.re_export(production, edges, ["item"], max_rounds=5)


def test_every_list_length_gets_all_its_choices(spark):
    rows = [r for r in lists.hidden_positions(spark, 60).where("n in (5, 14, 15, 20, 60)").collect()]
    for n in (5, 14, 15, 20, 60):
        for k in range(2, n + 1):
            own = [tuple(r["hidden"]) for r in rows if (r["n"], r["k"]) == (n, k)]
            assert len(own) == len(set(own)) == min(100, math.comb(n, k))
            assert all(list(h) == sorted(set(h)) and len(h) == k and 1 <= h[0] and h[-1] <= n for h in own)
    again = lists.hidden_positions(spark, 60).where("n = 60").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in rows if r["n"] == 60)


def test_combinations_of_a_list_of_60_places(spark, monkeypatch):
    from larder.catalog import joins

    monkeypatch.setattr(joins, "derived", lambda *_: spark.range(60).select(F.lit(1).alias("id")))
    got = {r["k"]: (r["n"], r["combos"], r["hidden"]) for r in joins.set08(spark, "").collect()}
    assert got == {k: (60, min(100, math.comb(60, k)), min(100, math.comb(60, k)) * k) for k in range(2, 61)}
