"""Small fixed dimensions that the pipelines need; real runs may pass their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values -------------------------------------------------------------------------------
MILLING = {"Rice": 0.7}
USE_ELEMENTS = [
    "Feed", "Food", "Loss", "Other uses (non-food)", "Residuals", "Seed", "Processed", "Tourist consumption",
]
TRADE_YEARS = [2017, 2018, 2019, 2020, 2021]
FISH_TRADE_YEARS = [2019, 2020, 2021, 2022]
FACTOR_YEARS = [2018, 2019, 2020, 2021, 2022]
FISH_GROUPS = {
    "fish": ["Freshwater Fish", "Demersal Fish", "Pelagic Fish", "Marine Fish, Other"],
    "crustaceans": ["Crustaceans", "Cephalopods", "Molluscs, Other"],
}
SUGAR_CROPS = ["Sugar beet", "Sugar cane"]
SHARED_SUGARS = ["Raw cane or beet sugar (centrifugal only)", "Refined sugar"]

# item: goods it is made of, goods whose supply is not processing
FLOW_SPLITS = {
    "Olives": (["Olives"], ["Olives preserved"]),
    "Coconuts, in shell": (["Coconuts, in shell"], ["Coconuts, desiccated"]),
    "Groundnuts, excluding shelled": (["Groundnuts, excluding shelled"], ["Groundnuts, shelled", "Prepared groundnuts"]),
    "Soya beans": (["Soya beans"], ["Soya paste", "Soya sauce", "Soya curd"]),
    "Milk, Total": (
        ["Raw milk of buffalo", "Raw milk of camel", "Raw milk of cattle", "Raw milk of goats", "Raw milk of sheep"],
        ["Butter and ghee of sheep milk", "Butter of cow milk", "Butter of goat milk",
         "Buttermilk, curdled and acidified milk", "Buttermilk, dry", "Cream, fresh", "Dairy products n.e.c.",
         "Ghee from buffalo milk", "Ghee from cow milk", "Ice cream and other edible ice", "Skim milk of cows",
         "Skim milk, condensed", "Skim milk, evaporated", "Whole milk powder", "Whole milk, condensed",
         "Whole milk, evaporated", "Yoghurt", "Yoghurt, with additives"],
    ),
}

# oil and the cake pressed with it
OIL_CAKES = {
    "Groundnut oil": "Cake of groundnuts", "Oil of linseed": "Cake of  linseed", "Oil of hempseed": "Cake of hempseed",
    "Sunflower-seed oil, crude": "Cake of sunflower seed", "Safflower-seed oil, crude": "Cake of safflowerseed",
    "Oil of sesame seed": "Cake of sesame seed", "Cottonseed oil": "Cake of cottonseed",
    "Mustard seed oil, crude": "Cake of mustard seed", "Rapeseed or canola oil, crude": "Cake of rapeseed",
}
CASTOR_OILS = ["Oil of castor beans", "Castor oil, hydrogenated"]
PALM_OILS = ["Palm oil", "Oil of palm kernel"]

# life-cycle category: trade categories it is sourced from
LCA_SOURCES = {
    "Wheat & Rye (Bread)": ["wheat", "rye", "millet", "sorghum", "other_cereals", "other_oilcrops"],
    "Maize (Meal)": ["maize"], "Barley (Beer)": ["barley"], "Oatmeal": ["oats"], "Rice": ["rice"],
    "Potatoes": ["potatoes", "sweet_potatoes_yams", "other_tubers"], "Cassava": ["cassava"],
    "Cane Sugar": ["cane_sugar"], "Beet Sugar": ["beet_sugar"], "Other Pulses": ["beans", "lentils", "lupins"],
    "Peas": ["peas"], "Nuts": ["almonds", "cashews", "hazelnuts", "chestnuts", "walnuts", "snfl_seed", "othr_nuts"],
    "Groundnuts": ["jgrnd"], "Soymilk": ["jsoyb"], "Tofu": ["jsoyb"], "Soybean Oil": ["soyb_oil"],
    "Palm Oil": ["palm_oil"], "Sunflower Oil": ["snfl_seed_oil"], "Rapeseed Oil": ["jrpsd"], "Olive Oil": ["olive_oil"],
    "Tomatoes": ["tomatoes"], "Onions & Leeks": ["onions", "leeks"], "Root Vegetables": ["carrots"],
    "Brassicas": ["cabbage", "broc_cauli"],
    "Other Vegetables": ["cucumber", "squash", "artichokes", "lettuce_chicory", "green_beans", "other_veg"],
    "Citrus Fruit": ["oranges", "lemons", "other_citrus"], "Bananas": ["bananas"], "Apples": ["apples"],
    "Berries & Grapes": ["strawberries", "raspberries", "other_berries", "grapes"], "Wine": ["wine"],
    "Other Fruit": ["pears", "peach", "avacado", "melon", "kiwi", "other_fruit", "olives"], "Coffee": ["coffee"],
    "Dark Chocolate": ["chocolate"], "Bovine Meat (beef herd)": ["beef"], "Bovine Meat (dairy herd)": ["beef"],
    "Lamb & Mutton": ["lamb"], "Pig Meat": ["pork"], "Poultry Meat": ["chicken", "turkey", "other_poultry"],
    "Milk": ["milk"], "Cheese": ["cheese"], "Eggs": ["eggs"], "Fish (farmed)": ["fish"],
    "Crustaceans (farmed)": ["crustaceans"],
}

LCA_COPIES = {"Milk": ["Butter, Cream & Ghee"], "Rapeseed Oil": ["Oils Misc."], "Pig Meat": ["Animal Fats"]}
FISH_COPIES = {"Shrimps": ["Prawns"]}
# ---- end of fixed values ------------------------------------------------------------------------


def factor_formulas() -> dict[str, tuple[list[tuple[str, str, int]], list[tuple[str, str]]]]:
    """How the crop factors of oils and sweeteners are computed from world supply and processing."""
    out = {oil: ([(oil, "supply", 1), (cake, "supply", 1)], [(oil, "supply")]) for oil, cake in OIL_CAKES.items()}
    for oils, crop in ((CASTOR_OILS, "Castor oil seeds"), (PALM_OILS, "Oil palm fruit")):
        out |= {oil: ([(crop, "processed", 1)], [(o, "supply") for o in oils]) for oil in oils}
    out["Olive oil"] = ([("Olives", "processed", 1), ("Olives preserved", "supply", -1)], [("Olive oil", "supply")])
    out["Coconut oil"] = ([], [])
    out["Sugar & Sweeteners"] = ([("Sugar Crops", "processed", 1)], [("Sugar & Sweeteners", "supply")])
    return out


def pairs(spark: SparkSession, mapping: dict[str, list[str]], key: str, value: str) -> DataFrame:
    """A one-to-many mapping as a two-column table."""
    rows = [(k, v) for k, vs in mapping.items() for v in vs]
    return spark.createDataFrame(rows, f"{key} string, {value} string")
