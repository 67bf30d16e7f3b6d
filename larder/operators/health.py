"""Disease relative risk of products from their composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.relational import anti
from larder.operators.summaries import product_of, two_step_sum

# ---- fixed values -------------------------------------------------------------------------------
SERVINGS = {
    "Chicken": 100, "Dairy": 200, "Eggs": 50, "Fish": 100, "Fruits": 100, "Legumes": 50, "Nuts": 28, "Olive oil": 10,
    "Potatoes": 150, "Processed red meat": 50, "Unprocessed red meat": 100, "Refined grains": 30, "SSBs": 225,
    "Vegetables": 100, "Whole grains": 30,
}
POTATO_RISK = ("Potatoes", "ACM", 0.88, 0.69, 1.12)
RED_MEAT = ["Pig Meat", "Lamb & Mutton", "Bovine Meat (beef herd)", "Bovine Meat (dairy herd)"]
WHITE_MEAT = ["Poultry", "Poultry Meat", "Fish (farmed)", "Crustaceans (farmed)", "Fish", "Crustaceans"]
GRAINS = ["Barley (Beer)", "Cereals & Oilcrops Misc.", "Maize (Meal)", "Pasta", "Rice", "Wheat & Rye (Bread)"]
PROCESSED_RED = (
    r"bacon|ham|hot\s?dog|beef\s?jerky|biltong|pepperoni|sausage|bratwurst|roast\s?beef|pastrami|corned\s?beef|salami|"
    r"deli\s?meat|pates?|patés?|pâtés?"
)
PROCESSED_WHITE = r"bacon|hot\s?dog|sausage|bratwurst|jerky|pates?|patés?|pâtés?"
CURED = "smoked|cured|salted"
WHOLE = r"whole\s?grain|whole\s?meal|brown\s?rice|whole|stoneground\s?whole|oats|oatmeal|porridge"
GROUPS = {
    "Chicken": ["Poultry Meat"], "Dairy": ["Milk", "Cheese", "Butter, Cream & Ghee"], "Eggs": ["Eggs"],
    "Fish": ["Fish (farmed)", "Crustaceans (farmed)", "Fish", "Crustaceans"],
    "Fruits": ["Apples", "Bananas", "Berries & Grapes", "Citrus Fruit", "Other Fruit"],
    "Vegetables": ["Brassicas", "Onions & Leeks", "Root Vegetables", "Tomatoes"],
    "Legumes": ["Peas", "Other Pulses", "Tofu"], "Nuts": ["Nuts", "Sunflower seeds", "Groundnuts"],
    "Olive oil": ["Olive Oil", "Rapeseed Oil", "Sunflower Oil"], "Potatoes": ["Potatoes", "Cassava"],
    "Unprocessed red meat": RED_MEAT, "Refined grains": GRAINS,
}
SWEET_DRINK_SUGAR = 8
# ---- end of fixed values ------------------------------------------------------------------------

RISKS = ["mean_rr", "lower_rr", "upper_rr"]


def risk_group(value: Column, product_name: Column, category: Column) -> Column:
    """Relative-risk group: processed meats and whole grains by name, everything else by category."""
    has = lambda c, p: F.coalesce(c.rlike(f"(?i){p}"), F.lit(False))
    red = category.isin(RED_MEAT) & (has(value, PROCESSED_RED) | has(product_name, f"{PROCESSED_RED}|{CURED}"))
    white = category.isin(WHITE_MEAT) & (has(value, PROCESSED_WHITE) | has(product_name, f"{PROCESSED_WHITE}|{CURED}"))
    whole = category.isin(GRAINS) & (has(value, WHOLE) | has(product_name, WHOLE))
    out = F.when(red | white, "Processed red meat").when(whole, "Whole grains")
    for group, names in GROUPS.items():
        out = out.when(category.isin(names), group)
    return out


def sweet_drinks(nutrition: DataFrame, packs: DataFrame | None = None) -> DataFrame:
    """Names of drinks with much sugar, estimated or printed.

    ``nutrition`` needs ``product_name``, ``drinks`` and ``sugar``; ``packs`` has ``sugar_pack``.
    """
    drinks = nutrition.where("drinks = 'Drinks'")
    names = drinks.where(F.col("sugar") >= SWEET_DRINK_SUGAR).select("product_name")
    if packs is not None:
        printed = packs.where(F.col("sugar_pack") >= SWEET_DRINK_SUGAR).select("product_name")
        names = names.union(drinks.select("product_name").join(printed, "product_name", "left_semi"))
    return names.distinct()


def risk_per_100g(risks: DataFrame, servings: dict[str, float] = SERVINGS) -> DataFrame:
    """Relative risk per serving raised to 100 g."""
    size = risks.sparkSession.createDataFrame([(k, float(v)) for k, v in servings.items()], "rr_group string, serving double")
    out = risks.join(size, "rr_group", "left")
    return out.withColumns({r: F.pow(F.col(r), F.lit(100.0) / F.col("serving")) for r in RISKS}).drop("serving").distinct()


def relative_risk(items: DataFrame, risks: DataFrame, sweet_drinks: DataFrame | None = None, alcohol: DataFrame | None = None,
                  servings: dict[str, float] = SERVINGS) -> DataFrame:
    """Relative risk per product name and outcome: product over groups of risk ** (share / 100).

    Products with a negative share and alcoholic ones are left out; groups without a known risk count 1.
    ``items`` needs ``product_name``, ``value``, ``percent`` and ``rr_group``.
    """
    good = anti(items, items.where("percent < 0"), ["product_name"])
    if alcohol is not None:
        good = anti(good, alcohol, ["product_name"])
    good = good.withColumn("value", F.lower("value"))
    shares = two_step_sum(good, ["product_name", "rr_group"], "value", "percent").where("rr_group IS NOT NULL")
    if sweet_drinks is not None:
        marked = sweet_drinks.select("product_name").distinct().withColumn("__sweet", F.lit(True))
        shares = shares.join(marked, "product_name", "left")
        shares = shares.withColumn("rr_group", F.when(F.col("__sweet"), "SSBs").otherwise(F.col("rr_group"))).drop("__sweet")
    out = shares.join(risk_per_100g(risks, servings), "rr_group", "left")
    share = F.least(F.col("percent"), F.lit(100.0)) / 100
    out = out.withColumns({r: F.pow(F.coalesce(F.col(r), F.lit(1.0)), share) for r in RISKS})
    return product_of(out, ["product_name", "outcome"], RISKS)
