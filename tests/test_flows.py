"""End-to-end flows, invariants and worked examples."""

from pyspark.sql import functions as F

from larder.fixtures import derived
from larder.functions.cleaning import clean_ingredients, correct_structure
from larder.functions.nested import parse_list, printed_percent_items, split_top_level
from larder.operators import health
from larder.operators import impacts as im
from larder.operators import lca as lc
from larder.operators import matching as mt
from larder.operators import reexport, trade
from larder.operators import regression as rg
from larder.plans import impacts as pi
from larder.plans import sourcing as ps
from larder.streaming.incremental import ingest_new_files


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()[0]


def test_nested_list(spark):
    items = one(spark, "bread (20%) (flour, water), oil, salt", parse_list)
    assert [(x.pos, x.value, x.embedded) for x in items] == [(1, "bread (20%)", "flour, water"), (2, "oil", None), (3, "salt", None)]
    assert one(spark, "a, b (c, d, e", split_top_level) == ["a", "b (c, d, e"]
    assert one(spark, "a), b, c", split_top_level) == ["a)", "b", "c"]
    assert one(spark, "a,b,c,d", lambda t: split_top_level(t, 3)) == ["a", "b", "c,d"]


def test_printed_percent_of_several(spark):
    df = spark.createDataFrame([("tomato (60%), sauce 70% 30%, oil 5%, salt",)], "t string")
    got = [(r.x.pos, r.x.percent) for r in printed_percent_items(df, F.col("t")).collect()]
    assert got == [(1, 60.0), (2, 30.0), (3, 5.0), (4, None)]


def test_cleaning(spark):
    assert one(spark, "Ingredients: Crème [12 per cent]; Œuf. May contain nuts", clean_ingredients) == "creme (12%), oeuf."
    assert one(spark, "(20%) tomato, beef (lean) (10%)", correct_structure) == "tomato (20%), beef (10%) (lean)"


def test_accuracy_level(spark):
    rows = [(9.0, 0.0), (100.0, 95.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double").select(trade.accuracy_level(F.col("a"), F.col("b"))).collect()]
    assert got[0] == -1 and abs(got[1] - 0.0512820) < 1e-6


def test_re_export_worked_example(spark):
    p = spark.createDataFrame([("x", 1, 100.0)], "g string, iso3 int, production double")
    e = spark.createDataFrame([("x", 1, 2, 40.0), ("x", 2, 3, 10.0)], "g string, exporter int, importer int, qty double")
    got = {(r.origin, r.consumer): round(r.supply, 6) for r in reexport.re_export(p, e, ["g"]).collect()}
    assert got == {(1, 1): 60.0, (1, 2): 30.0, (1, 3): 10.0}


def test_re_export_keeps_production(spark):
    """Rows add up to production, also with a loop and a country that exports more than it has."""
    p = spark.createDataFrame([("x", 1, 100.0), ("x", 2, 50.0), ("x", 3, 5.0)], "g string, iso3 int, production double")
    edges = [("x", 1, 2, 40.0), ("x", 2, 3, 30.0), ("x", 3, 1, 200.0), ("x", 2, 1, 10.0)]
    e = spark.createDataFrame(edges, "g string, exporter int, importer int, qty double")
    out = reexport.re_export(p, e, ["g"])
    rows = {r.origin: r.s for r in out.groupBy("origin").agg(F.sum("supply").alias("s")).collect()}
    assert all(abs(rows[i] - v) < 1e-5 * v for i, v in ((1, 100.0), (2, 50.0), (3, 5.0)))
    assert out.where("supply < 0").count() == 0


def test_sourcing_flow(spark, sf_dir):
    area = derived(spark, sf_dir, "area")
    years = [1996, 1997]
    supply = ps.supply_by_origin(derived(spark, sf_dir, "production"), derived(spark, sf_dir, "trade"), area, {"SMALL": ["SMALL"], "PROMO": ["PROMO"]}, years)
    weights, log = ps.country_weights(supply, derived(spark, sf_dir, "lca"), area)
    sums = weights.groupBy("consumer", "category").agg(F.sum("weight").alias("w"))
    assert sums.count() > 0 and sums.where("abs(w - 100) > 1e-6").count() == 0
    assert log.count() == sums.count()


def test_impact_flow(spark, sf_dir):
    composed = derived(spark, sf_dir, "ingprod").withColumn("percent", F.col("true_percent"))
    items = pi.scored_items(composed)
    stats, parts = pi.monte_carlo(items, derived(spark, sf_dir, "lca"), reps=20)
    row = stats.where("min_ghg > max_ghg * 10 OR mean_ghg IS NULL").count()
    assert stats.count() > 1000 and row == 0
    sums = parts.groupBy(*im.PRODUCT).agg(F.sum("ghg").alias("g"), F.sum("amount").alias("a"))
    assert sums.where("abs(g - 1) > 1e-9 OR abs(a - 1) > 1e-9").count() == 0


def test_equal_ids_of_two_shops_are_two_products(spark, sf_dir):
    one_shop = derived(spark, sf_dir, "ingprod").withColumn("percent", F.col("true_percent")).where("id <= 40")
    other = one_shop.withColumn("retailer", F.concat("retailer", F.lit(" 2")))
    stats, _ = pi.monte_carlo(pi.scored_items(one_shop.union(other)), derived(spark, sf_dir, "lca"), reps=20)
    assert stats.count() == stats.select("id", "retailer").distinct().count() == 2 * stats.select("id").distinct().count()


def test_minimum_fat_is_butter(spark):
    rows = [("minimum 82% fat", "Salted Butter", None), ("minimum 82% fat", "Bread", None), ("min. fat", "butter", "Milk")]
    df = spark.createDataFrame(rows, "v string, p string, c string")
    assert [r[0] for r in df.select(mt.with_minimum_fat(F.col("v"), F.col("p"), F.col("c"))).collect()] == ["Butter, Cream & Ghee", None, "Milk"]


def test_a_fit_covers_places_beyond_64(spark):
    rows = [("a", p, 100.0 / (p * p)) for p in (1, 65, 129)]
    fit = rg.position_regression(spark.createDataFrame(rows, "k string, pos int, percent double"), ["k"], forms=(1,), max_pos=1000, min_coverage=0.0)
    sums = rg.place_sums(spark.createDataFrame(rows, "k string, pos int, percent double"), ["k"])
    assert sums.agg(rg.fit_sums(1000)["seen"].alias("seen")).first()["seen"] == 3 and fit.first()["accepted"]


def test_nutrition_flow(spark, sf_dir):
    composed = derived(spark, sf_dir, "ingprod").withColumn("percent", F.col("true_percent"))
    items = pi.scored_items(composed)
    base = derived(spark, sf_dir, "lca").groupBy("food_category").agg(*[F.avg("eut").alias(n) for n in im.NUTRIENTS])
    packs = composed.select("product_name").distinct().withColumns({f"{n}_pack": F.lit(5.0) for n in im.PACK})
    out = pi.nutrition(items, base, packs)
    assert out.count() > 1000 and out.where("score_letter IS NULL").count() == 0


def test_final_tables(spark, sf_dir):
    """From composition to statistics, bases, both scalings and relative risk, on assembled observations."""
    names = {"SMALL": "Pig Meat", "MEDIUM": "Milk", "LARGE": "Apples", "PROMO": "Rice", "ECONOMY": "Poultry Meat", "STANDARD": "Cane Sugar"}
    renamed = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    food = lambda df: df.withColumn("food_category", F.coalesce(renamed[F.col("food_category")], "food_category"))
    composed = food(derived(spark, sf_dir, "ingprod").withColumn("percent", F.col("true_percent")))
    lca = food(derived(spark, sf_dir, "lca"))
    raw = lca.select(*[c for c in lca.columns if c not in ("food_category_sub", "food_category_sub_sub")], F.coalesce("food_category_sub", F.lit("any")).alias("product_details"))
    subs = lca.select("food_category", F.coalesce("food_category_sub", F.lit("any")).alias("product_details"), "food_category_sub", F.lit(None).cast("string").alias("food_category_sub_sub")).distinct()
    ratios = spark.createDataFrame([("Butter, Cream & Ghee", "Milk", *[0.5] * len(lc.INDICATORS))], ["derived", "original", *lc.INDICATORS])
    base = lca.groupBy("food_category").agg(*[F.avg("eut").alias(n) for n in im.NUTRIENTS])
    packs = composed.select("product_name").distinct().withColumns({f"{n}_pack": F.lit(5.0) for n in im.PACK})
    products = composed.select(*im.PRODUCT).distinct().withColumn("serving_text", F.when(F.col("id") % 3 == 0, "serving 30g"))
    risks = spark.createDataFrame([("Fruits", "ACM", 0.94, 0.9, 0.97), ("Dairy", "ACM", 0.98, 0.95, 1.01)], "rr_group string, outcome string, mean_rr double, lower_rr double, upper_rr double")
    out = pi.final_tables(composed, raw, base, packs, products, risks, (subs, ratios), reps=20)
    wide = out["impacts"].cache()
    assert wide.count() > 1000 and wide.select(*im.PRODUCT).distinct().count() == wide.count()
    tops = wide.agg(F.max("scaled_mean_ghg"), F.max("scaled_serving_mean_ghg"), F.max("total_scaled_mean"), F.max("total_scaled_serving_mean"), F.max("ghg_protein_scaled")).first()
    assert all(abs(x - y) < 1e-9 for x, y in zip(tops, (100, 100, 100, 100, 1), strict=True))
    assert wide.where("abs(serving_mean_ghg - mean_ghg * serving_value / 100) > 1e-9 OR serving_value IS NULL OR score_letter IS NULL").count() == 0
    assert wide.where("serving_value = 30").count() > 0 and out["contributions"].count() > wide.count()
    risk = out["relative_risk"]
    assert risk.count() > 0 and risk.where("mean_rr > 1 OR lower_rr > mean_rr OR upper_rr < mean_rr").count() == 0


def test_sweet_drinks(spark):
    rows = [("cola", "Drinks", 10.0), ("water", "Drinks", 0.0), ("juice", "Drinks", None), ("cake", "No", 30.0)]
    packs = spark.createDataFrame([("juice", 8.0), ("cake", 30.0)], "product_name string, sugar_pack double")
    got = health.sweet_drinks(spark.createDataFrame(rows, "product_name string, drinks string, sugar double"), packs)
    assert sorted(r[0] for r in got.collect()) == ["cola", "juice"]


def test_incremental_ingest(spark, sf_dir, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = derived(spark, sf_dir, "dirty")
    rows.where("id % 2 = 0").write.parquet(source)
    ingest_new_files(spark, source, "id bigint, ingredients_text string", "ingredients_text", target, state).awaitTermination()
    first = spark.read.parquet(target).count()
    rows.where("id % 2 = 1").write.mode("append").parquet(source)
    ingest_new_files(spark, source, "id bigint, ingredients_text string", "ingredients_text", target, state).awaitTermination()
    assert first == rows.where("id % 2 = 0").count() and spark.read.parquet(target).count() == rows.count()


def test_draws_do_not_depend_on_the_join(spark, sf_dir, monkeypatch):
    """Broadcast pools and pools joined by bucket give the same observations."""
    from larder.operators import montecarlo as mc

    foods = derived(spark, sf_dir, "ing").groupBy(F.col("id").alias("product"), "food_category", "food_category_sub", "food_category_sub_sub")
    foods = foods.agg(F.sum("true_percent").alias("amount")).withColumn("organic", F.lit("Not Organic"))
    lca = mc.prepared(derived(spark, sf_dir, "lca"))
    small = mc.sampled(foods, lca, reps=2).select("product", "pool", "rep", "obs_id")
    monkeypatch.setattr(mc, "BROADCAST_ROWS", 0)
    large = mc.sampled(foods, lca, reps=2).select("product", "pool", "rep", "obs_id")
    assert small.count() > 0 and small.exceptAll(large).count() == 0 and large.exceptAll(small).count() == 0
