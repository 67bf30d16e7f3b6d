"""From composition and life-cycle observations to impacts, nutrition and scores per product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import foods, labels
from larder.functions.nutriscore import nutri_score
from larder.operators import health, matching
from larder.operators import impacts as im
from larder.operators import lca as lc
from larder.operators import montecarlo as mc
from larder.operators import simulation as sm
from larder.session import reliable_checkpoint


def scored_items(composed: DataFrame) -> DataFrame:
    """Composition with salt, water, plant milks, stock and organic ingredients told apart."""
    out = composed.withColumn("brewed", foods.brewed(F.col("product_name"), F.col("value"), F.col("food_category")))
    missing = F.col("food_category").isNull()
    has = lambda p: F.coalesce(F.col("value").rlike(p), F.lit(False))
    category = F.when(missing & has(r"(?i)\bsalt\b"), "Salt").when(missing & has("(?i)water"), "Water").otherwise(F.col("food_category"))
    out = out.withColumn("food_category", category)
    out = out.withColumn("food_category", matching.plant_milk(F.col("product_name"), F.col("food_category"), F.col("percent")))
    out = out.withColumn("percent", foods.broth_percent(F.col("value"), F.col("percent")))
    return out.withColumn("organic", foods.organic(F.col("value"), F.col("product_name")))


def nutrition(items: DataFrame, nutrients: DataFrame, packs: DataFrame) -> DataFrame:
    """Nutrition score per product: printed nutrition where credible, else estimated from the composition."""
    keys = im.PRODUCT
    table = im.nutrient_table(items, nutrients, keys).join(im.fruit_and_sugar(items, keys), keys, "left")
    table = im.with_pack_nutrition(table, packs)
    return nutri_score(table.join(im.product_types(items, items), "product_name", "left"))


def monte_carlo(items: DataFrame, lca: DataFrame, reps: int = mc.REPETITIONS, seed: int = 19) -> tuple[DataFrame, DataFrame]:
    """Impact statistics per product, and the contributions of food categories; a product is its whole key."""
    frame = im.food_frame(items, im.PRODUCT, items.where("brewed = 'Coffee'")).where("food_category IS NOT NULL")
    # the number seeds the draws and keeps a product's rows together; sums are by the whole key
    number = F.xxhash64(*im.PRODUCT).bitwiseAND(F.lit(2**62 - 1))
    keys = ["product", *im.PRODUCT]
    observations = reliable_checkpoint(mc.prepared(lca))
    frame = reliable_checkpoint(frame.withColumn("product", number))
    kept = [f"{n}_{i}" for i in lc.INDICATORS for n in ("mean", "se", "lower_ci", "upper_ci", *mc.RANKS)]
    stats = sm.statistics(frame, observations, keys, reps, seed).select(*im.PRODUCT, *kept)
    return stats, sm.contributions(frame, observations, keys, reps, seed).drop("product")


def servings(products: DataFrame) -> DataFrame:
    """Serving size per product name from the printed text (``serving_text``), else the mean of its shelf, aisle or department."""
    printed = labels.serving(F.col("serving_text"), F.col("product_name"))
    return im.imputed_serving(products.withColumn("__s", printed).withColumn("serving_value", F.col("__s.value").cast("double")).drop("__s"))


def final_tables(
    composed: DataFrame, observations: DataFrame, nutrients: DataFrame, packs: DataFrame, products: DataFrame, risks: DataFrame,
    assembly: tuple[DataFrame, DataFrame] | None = None, capture: DataFrame | None = None, reps: int = mc.REPETITIONS, seed: int = 19,
    indicators: list[str] = lc.SCORED,
) -> dict[str, DataFrame]:
    """All result tables of scored products.

    ``impacts``: statistics per 100 g and per serving with both scalings, the four bases with theirs, nutrition and letter;
    ``contributions`` of food categories; ``relative_risk`` per product name and outcome.  ``products`` needs ``serving_text``
    and the keys of a product; ``assembly`` holds the sub-categories and ratios that turn raw ``observations`` into all foods.
    """
    lca = observations if assembly is None else lc.assembled(observations, *assembly, capture)
    items = reliable_checkpoint(scored_items(composed))
    stats, parts = monte_carlo(items, lca, reps, seed)
    scores = reliable_checkpoint(nutrition(items, nutrients, packs))
    wide = stats.join(scores.drop("country_group"), im.PRODUCT).join(servings(products), "product_name", "left")
    wide = reliable_checkpoint(wide)  # scaled by its own maxima
    kinds = ["mean", "lower_ci", "upper_ci", *mc.RANKS]
    wide = im.scaled_statistics(im.per_serving(wide, indicators, kinds), indicators, kinds)
    wide = im.scaled_statistics(wide, indicators, kinds, None, "serving_")
    wide = im.scaled_bases(im.per_basis(wide.withColumns({f"{i}_100g": F.col(f"mean_{i}") for i in indicators}), indicators), indicators)
    grouped = items.withColumn("rr_group", health.risk_group(F.col("value"), F.col("product_name"), F.col("food_category")))
    alcohol = scores.where("alcohol = 'Alcohol'").select("product_name").distinct()
    risk = health.relative_risk(grouped, risks, health.sweet_drinks(scores, packs), alcohol)
    return {"impacts": wide, "contributions": parts, "relative_risk": risk}
