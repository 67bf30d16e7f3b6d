"""Product-level impacts, nutrition and scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import no_null_tokens
from larder.operators.relational import anti, first_filled, join_null_safe, semi
from larder.operators.summaries import scaled_by_max

PRODUCT = ["id", "product_name", "retailer", "country", "department", "aisle", "shelf"]
CATEGORY = ["food_category", "food_category_sub", "food_category_sub_sub"]

# ---- fixed values -------------------------------------------------------------------------------
FVNO_CATEGORIES = [
    "Apples", "Bananas", "Berries & Grapes", "Brassicas", "Citrus Fruit", "Groundnuts", "Nuts", "Olives", "Onions & Leeks",
    "Other Pulses", "Other Vegetables", "Peas", "Root Vegetables", "Tofu", "Tomatoes", "Olive Oil", "Rapeseed Oil",
]
SUGARS = ["Cane Sugar", "Beet Sugar"]
NUTRIENTS = ["calories", "protein", "fat", "saturated_fat", "fiber", "sodium", "carbohydrates"]
SODIUM_PER_SALT = 1000 / 2.5
KCAL_PER_GRAM = {"fat": 8.84, "carbohydrates": 4.0, "protein": 4.0}
DRINK_CATEGORIES = ["Water", "Milk", "Soymilk", "Rice milk", "Almond milk", "Oat milk"]
FAT_CATEGORIES = [
    "Butter, Cream & Ghee", "Oils Misc.", "Olive Oil", "Palm Oil", "Rapeseed Oil", "Soybean Oil", "Sunflower Oil",
]
FAT_SHELVES = [
    "Butter, Spreads & Margarine", "Butter, Fats & Spreads", "Butter, spreads & pastry", "Butter, Spreads & Pastry",
    "Butters, Fats & Spreads", "Oils", "Oil", "Oils & Fats", "Oils & Vinegar", "Oils & Vinegars",
]
NOT_FAT = "Vinegar|pastry|jus ros|jus-ros|jr feuille|dough|balsamic"
DRINK_DEPARTMENTS = ["Drinks", "Soft Drinks, Tea & Coffee", "Tea, Coffee & Soft Drinks"]
ALCOHOL_DEPARTMENTS = ["Beer, wine & spirits", "Beer, Wine & Spirits", "Beer, Wines & Spritis"]
# ---- end of fixed values ------------------------------------------------------------------------


def impacts_per_100g(items: DataFrame, lca: DataFrame, keys: list[str], indicators: list[str]) -> DataFrame:
    """Sum of category impact (per kg) times share; ingredients without a category add nothing."""
    joined = join_null_safe(items, lca.select("food_category", *indicators), ["food_category"])
    return joined.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.col(i) / 10 * F.col("percent") / 100), F.lit(0.0)).alias(f"{i}_100g") for i in indicators]
    )


def food_frame(items: DataFrame, keys: list[str], brewed: DataFrame | None = None) -> DataFrame:
    """Amount per product, category and organic flag; ``brewed`` holds the keys of the brewed products.

    Products with any share of 0 or less are left out; additives count without a category.
    """
    good = anti(items, items.where("percent <= 0"), keys)
    out = good.where("food_category IS NOT NULL").groupBy(*keys, *CATEGORY, "organic").agg(F.sum("percent").alias("amount"))
    if brewed is not None:
        out = join_null_safe(out, brewed.select(*keys).distinct().withColumn("__b", F.lit(True)), keys)
        coffee = F.col("__b") & (F.col("food_category") == "Coffee") & (F.col("amount") >= 10)
        out = out.withColumn("brewed", F.when(coffee, "Coffee").otherwise("No")).drop("__b")
    trace = F.col("food_category").isin("Vitamin", "Mineral", "Other Food Additive")
    return out.withColumn("food_category", F.when(~trace, F.col("food_category")))


def identified(items: DataFrame, keys: list[str], at_least: float = 75.0) -> DataFrame:
    """Products of which at least three quarters are identified; sums are told from the bound to nine digits, whatever their order."""
    known = items.where("food_category IS NOT NULL").groupBy(*keys).agg(F.sum("percent").alias("tot_percent"))
    return known.where(F.round("tot_percent", 9) >= at_least)


def fruit_and_sugar(items: DataFrame, keys: list[str]) -> DataFrame:
    """Share of fruit, vegetables, nuts and good oils, and of sugar; walnut oil counts as olive oil."""
    walnut = F.coalesce(F.col("value").rlike("(?i)walnut.*oil"), F.lit(False))
    category = F.when(walnut, "Olive Oil").otherwise(F.col("food_category"))
    part = lambda names: F.coalesce(F.sum(F.when(category.isin(names), F.col("percent"))), F.lit(0.0))
    return items.groupBy(*keys).agg(part(FVNO_CATEGORIES).alias("fvno"), part(SUGARS).alias("sugar"))


def estimated_nutrients(items: DataFrame, nutrients: DataFrame, keys: list[str]) -> DataFrame:
    """Nutrients per 100 g from the composition; salt ingredients set the sodium."""
    out = join_null_safe(items, nutrients.select("food_category", *NUTRIENTS), ["food_category"])
    salt = F.coalesce(F.col("food_category") == "Salt", F.lit(False))
    amount = {n: F.col(n) * F.col("percent") / 100 for n in NUTRIENTS}
    amount["sodium"] = F.when(salt, F.col("percent") * SODIUM_PER_SALT).otherwise(amount["sodium"])
    return out.groupBy(*keys).agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(n) for n, v in amount.items()])


def nutrient_table(items: DataFrame, nutrients: DataFrame, keys: list[str]) -> DataFrame:
    """Estimated nutrients of products that are identified well enough and have no negative share."""
    out = estimated_nutrients(items, nutrients, keys)
    return semi(anti(out, items.where("percent < 0"), keys), identified(items, keys), keys)


PACK = ["sugar", "fat", "saturated_fat", "salt", "protein", "fiber", "carbohydrates", "energy"]


def pack_nutrition(packs: DataFrame) -> DataFrame:
    """Printed nutrition per product name, with ``doubtful`` = 1 where it cannot be true."""
    means = packs.groupBy("product_name").agg(*[F.avg(no_nan(F.col(f"{n}_pack"))).alias(f"{n}_pack") for n in PACK])
    over = [F.coalesce(F.col(f"{n}_pack") > 100, F.lit(False)) for n in PACK if n != "energy"]
    over.append(F.coalesce(F.col("saturated_fat_pack") > F.col("fat_pack") + 5, F.lit(False)))
    return means.withColumn("doubtful", reduce(lambda a, b: a | b, over).cast("int"))


def no_nan(col: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(col), col)


def with_pack_nutrition(estimated: DataFrame, packs: DataFrame) -> DataFrame:
    """Printed values where they are present and credible, else the estimates; energy follows from the nutrients."""
    out = estimated.join(pack_nutrition(packs), "product_name", "left")
    good = F.coalesce(F.col("doubtful") == 0, F.lit(False))
    for n in ("sugar", "fat", "saturated_fat", "protein", "fiber", "carbohydrates"):
        if n in out.columns:
            out = out.withColumn(n, F.when(good & F.col(f"{n}_pack").isNotNull(), F.col(f"{n}_pack")).otherwise(F.col(n)))
    out = out.withColumn("sodium", F.when(good & F.col("salt_pack").isNotNull(), F.col("salt_pack") * SODIUM_PER_SALT).otherwise(F.col("sodium")))
    kcal = sum((F.col(n) * k for n, k in KCAL_PER_GRAM.items()), F.lit(0.0))
    return out.withColumn("calories", kcal).drop(*[f"{n}_pack" for n in PACK], "doubtful")


def product_types(products: DataFrame, items: DataFrame, drinks: list[str] = DRINK_DEPARTMENTS, alcohol: list[str] = ALCOHOL_DEPARTMENTS,
                  fat_shelves: list[str] = FAT_SHELVES, at_least: float = 90.0) -> DataFrame:
    """Flags per product name: drinks, alcohol, cheese, fats and oils, by place in the store or by content.

    ``drinks`` and ``alcohol`` are names of departments, aisles or shelves.
    """
    placed = lambda names: reduce(lambda a, b: a | b, [F.coalesce(F.col(c).isin(names), F.lit(False)) for c in ("department", "aisle", "shelf")])
    named = lambda c: F.coalesce(F.col(c).rlike("(?i)cheese"), F.lit(False))
    fat = F.coalesce(F.col("shelf").isin(fat_shelves), F.lit(False)) & ~F.col("product_name").rlike(f"(?i){NOT_FAT}")
    flag = lambda cond: F.max(cond.cast("int"))
    by_place = products.groupBy("product_name").agg(
        flag(placed(drinks)).alias("drinks"), flag(~placed(drinks) & placed(alcohol)).alias("alcohol"),
        flag(named("department") | named("aisle") | named("shelf")).alias("cheese"), flag(fat).alias("fat_oil"),
    )
    mostly = items.groupBy("id", "product_name").agg(
        F.sum(F.when(F.col("food_category").isin(DRINK_CATEGORIES), F.col("percent"))).alias("d"),
        F.sum(F.when(F.col("food_category").contains("Cheese"), F.col("percent"))).alias("c"),
        F.sum(F.when(F.col("food_category").isin(FAT_CATEGORIES), F.col("percent"))).alias("f"),
    )
    enough = lambda c: F.max(F.coalesce(F.col(c) >= at_least, F.lit(False)).cast("int"))
    by_content = mostly.groupBy("product_name").agg(enough("d").alias("d"), enough("c").alias("c"), enough("f").alias("f"))
    both = by_place.join(by_content, "product_name", "left")
    yes = lambda a, b, name: F.when((F.col(a) == 1) | F.coalesce(F.col(b) == 1, F.lit(False)), name).otherwise("No")
    return both.select(
        "product_name", yes("drinks", "d", "Drinks").alias("drinks"), F.when(F.col("alcohol") == 1, "Alcohol").otherwise("No").alias("alcohol"),
        yes("cheese", "c", "Cheese").alias("cheese"), yes("fat_oil", "f", "Fats.Oils").alias("fat_oil"),
    )


def per_basis(df: DataFrame, indicators: list[str]) -> DataFrame:
    """Impacts per serving, per 10 g of protein and per 100 kcal from those per 100 g."""
    for i in indicators:
        per = F.col(f"{i}_100g")
        df = df.withColumn(f"{i}_serving", per * F.col("serving_value") / 100)
        df = df.withColumn(f"{i}_protein", F.try_divide(per, F.col("protein") / 10))
        df = df.withColumn(f"{i}_calories", F.try_divide(per, F.col("calories") / 100))
    return df


BASES = ["100g", "serving", "protein", "calories"]


def scaled_bases(df: DataFrame, indicators: list[str], among: Column | None = None, bases: list[str] = BASES) -> DataFrame:
    """Each basis over its maximum, and the mean of the scaled indicators per basis."""
    columns = [f"{i}_{b}" for b in bases for i in indicators]
    df = scaled_by_max(df, columns, among=among)
    for b in bases:
        parts = [F.col(f"{i}_{b}_scaled") for i in indicators]
        df = df.withColumn(f"total_{b}_scaled", sum(parts[1:], parts[0]) / len(parts))
    return df


def per_serving(df: DataFrame, indicators: list[str], statistics: list[str]) -> DataFrame:
    """Statistics ``<statistic>_<indicator>`` per 100 g, also per serving as ``serving_<statistic>_<indicator>``."""
    return df.withColumns({f"serving_{s}_{i}": F.col(f"{s}_{i}") * F.col("serving_value") / 100 for i in indicators for s in statistics})


def scaled_statistics(df: DataFrame, indicators: list[str], statistics: list[str], points: str | None = "score_points", prefix: str = "") -> DataFrame:
    """Statistics columns ``<prefix><statistic>_<indicator>`` on a 0-100 scale set by the largest mean, with their totals.

    The nutrition score is moved and scaled to 0-100 as well, unless ``points`` is None.  The extremes are fetched as
    numbers (one row each), so that plans of several scalings don't contain each other.
    """
    seen = [F.max(f"{prefix}mean_{i}").alias(i) for i in indicators]
    seen += [] if points is None else [F.min(points).alias("low"), F.max(points).alias("high")]
    extremes = df.agg(*seen).first()
    df = df.withColumns({f"scaled_{prefix}{s}_{i}": F.try_divide(F.col(f"{prefix}{s}_{i}"), F.lit(extremes[i])) * 100 for i in indicators for s in statistics})
    totals = {}
    for s in statistics:
        parts = [F.col(f"scaled_{prefix}{s}_{i}") for i in indicators]
        totals[f"total_scaled_{prefix}{s}"] = sum(parts[1:], parts[0]) / len(parts)
    df = df.withColumns(totals)
    top = df.agg(F.max(f"total_scaled_{prefix}mean")).first()[0]
    df = df.withColumns({c: F.try_divide(F.col(c), F.lit(top)) * 100 for c in totals})
    if points is None:
        return df
    low, high = F.lit(extremes["low"]), F.lit(extremes["high"])
    return df.withColumn("score_scaled", F.try_divide(F.col(points) + F.abs(low), high + F.abs(low)) * 100)


def imputed_serving(df: DataFrame) -> DataFrame:
    """Serving size per product name; missing ones take the mean of their shelf, aisle or department."""
    levels = [["retailer", "department", "aisle", "shelf"], ["retailer", "department", "aisle"], ["retailer", "department"]]
    tables = [(df.groupBy(*k).agg(F.avg("serving_value").alias("serving_value")), k) for k in levels]
    return first_filled(df, tables, "serving_value").groupBy("product_name").agg(F.avg("serving_value").alias("serving_value"))


def tidy_lower_levels(df: DataFrame) -> DataFrame:
    """Null tokens in the lower category levels."""
    return df.withColumns({c: no_null_tokens(F.col(c)) for c in CATEGORY[1:]})
