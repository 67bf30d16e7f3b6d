"""Assembly of the life-cycle observations that products are matched to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.draws import normal_sql
from larder.operators.relational import copy_rows
from larder.sources import dims

# ---- fixed values -------------------------------------------------------------------------------
INDICATORS = ["land", "ghg", "eut", "watscar", "biodiversity", "acidification", "wateruse"]
SCORED = ["ghg", "eut", "watscar", "land"]
PLANT_MILKS = ["Almond milk", "Other nut milk", "Oat milk", "Soymilk", "Rice milk"]
CAPTURE_DRAWS = 100
CRUSTACEANS = ["Lobsters", "Shrimps", "Prawns"]
CAPTURE_SUB = {"Shrimps": "Shrimp", "Prawns": "Prawn"}
# ---- end of fixed values ------------------------------------------------------------------------

CATEGORY = ["food_category", "food_category_sub", "food_category_sub_sub"]


def converted(lca: DataFrame, ratios: DataFrame, indicators: list[str] = INDICATORS) -> DataFrame:
    """Observations of derived foods: those of the original food divided by a ratio per indicator.

    ``ratios`` has ``derived``, ``original`` and one column per indicator.  Kinds of cheese take only the
    observations of their own sub-category, semi-hard cheese those of medium cheese.
    """
    r = ratios.select(F.col("derived"), F.col("original").alias("food_category"), *[F.col(i).alias(f"__r_{i}") for i in indicators])
    out = lca.join(r, "food_category")
    sub = F.when(F.col("derived").contains("Semi"), "Medium Cheese").otherwise(F.col("derived"))
    out = out.where(~F.col("derived").contains("Cheese") | F.col("food_category_sub").eqNullSafe(sub))
    for i in indicators:
        out = out.withColumn(i, F.try_divide(F.col(i), F.col(f"__r_{i}")))
    return out.withColumn("food_category", F.col("derived")).select(*lca.columns)


def capture_draws(fish: DataFrame, draws: int = CAPTURE_DRAWS, seed: int = 19) -> DataFrame:
    """Impact draws per wild species from its median and 95% range; negative ones are dropped.

    ``fish`` has ``fish_id`` (an integer), ``fish``, ``median``, ``lower_95``, ``upper_95``.
    """
    sd = ((F.col("upper_95") - F.col("median")) + (F.col("median") - F.col("lower_95"))) / 2 / 1.96
    out = fish.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    out = out.withColumn("impact", F.col("median") + sd * F.expr(normal_sql(["fish_id", "draw"], seed)))
    return out.where("impact > 0").select("fish_id", "fish", "draw", "impact")


def capture_observations(draws: DataFrame, matches: DataFrame, weights: DataFrame) -> DataFrame:
    """Wild-caught observations: matched to sub-categories, weighted by production, in kg per 100 g.

    A species without a weight of its own takes the unassigned weight of its category.
    """
    d = copy_rows(draws, "fish", dims.FISH_COPIES)
    shell = F.col("fish").isin(CRUSTACEANS)
    d = d.withColumn("food_category", F.when(shell, "Crustaceans (capture)").otherwise("Fish (capture)"))
    d = d.join(matches.select("fish", F.col("sub").alias("food_category_sub")), "fish", "left")
    w = weights.groupBy("fish", "food_category").agg(F.sum("weight").alias("weight"))
    rest = w.where("fish = ''").select("food_category", F.col("weight").alias("__rest"))
    d = d.join(w, ["fish", "food_category"], "left").join(rest, "food_category", "left")
    sub = F.col("food_category_sub")
    for name, new in CAPTURE_SUB.items():
        sub = F.when(F.col("fish") == name, new).otherwise(sub)
    return d.select(
        "food_category", sub.alias("food_category_sub"), F.coalesce("weight", "__rest").alias("weight"), (F.col("impact") / 1000).alias("ghg"), "fish", "draw"
    )


def assembled(lca: DataFrame, subcategories: DataFrame, ratios: DataFrame, capture: DataFrame | None = None) -> DataFrame:
    """One table of observations: sub-categories, derived foods, copies, wild fish, and zero rows for salt and water.

    ``subcategories`` maps ``(food_category, product_details)`` to the two lower levels and says which levels
    are averages.
    """
    out = lca.join(subcategories, ["food_category", "product_details"], "left")
    out = converted(out, ratios).unionByName(out.where(~F.col("food_category").contains("Cheese")))
    other = out.where(F.col("food_category_sub").contains("Medium Cheese")).withColumn("food_category_sub", F.lit("Other Cheese"))
    out = out.unionByName(other)
    name = F.when((F.col("food_category") == "Almond milk") & ~F.coalesce(F.col("food_category_sub") == "Almonds", F.lit(False)), "Other nut milk")
    out = out.withColumn("food_category", F.coalesce(name, F.col("food_category")))
    plant = F.col("food_category").isin(PLANT_MILKS)
    for c in CATEGORY[1:]:
        out = out.withColumn(c, F.when(~plant, F.col(c)))
    out = copy_rows(out, "food_category", dims.LCA_COPIES)
    out = out.withColumn("food_category", farmed(F.col("food_category")))
    zero = lca.sparkSession.createDataFrame([("Salt", 1.0, "C"), ("Water", 1.0, "C")], "food_category string, weight double, sys string")
    zero = zero.withColumns({i: F.lit(0.0) for i in INDICATORS})
    out = out.unionByName(zero, allowMissingColumns=True)
    if capture is not None:
        filled = capture.withColumns({i: F.lit(0.0) for i in INDICATORS if i != "ghg"}).withColumn("sys", F.lit("C"))
        out = out.unionByName(filled.drop("fish", "draw"), allowMissingColumns=True)
    return out


def farmed(category: Column) -> Column:
    """'Fish (farmed)' and the like without the bracket."""
    return F.regexp_replace(category, r" \((farmed|wild caught)\)$", "")
