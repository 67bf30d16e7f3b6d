"""The five-letter nutrition score: points, exceptions, letters and the 0-1 scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import points_above

# ---- fixed values -------------------------------------------------------------------------------
KJ_PER_KCAL = 4.184
SOLID_ENERGY = [335, 670, 1005, 1340, 1675, 2010, 2345, 2680, 3015, 3350]
SOLID_SUGAR = [4.5, 9, 13.5, 18, 22.5, 27, 31, 36, 40, 45]
DRINK_ENERGY = [0, 30, 60, 90, 120, 150, 180, 210, 240, 270]
DRINK_SUGAR = [0, 1.5, 3, 4.5, 6, 7.5, 9, 10.5, 12, 13.5]
SATURATED_FAT = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
SODIUM = [90, 180, 270, 360, 450, 540, 630, 720, 810, 900]
FAT_RATIO = [0.1, 0.16, 0.22, 0.28, 0.34, 0.4, 0.46, 0.52, 0.58, 0.64]
FVNO = [40, 60, 80]
SOLID_FVNO_POINTS = [1, 2, 5]
DRINK_FVNO_POINTS = [2, 4, 10]
SOLID_FIBER = [0.7, 1.4, 2.1, 2.8, 3.5]
DRINK_FIBER = [0.9, 1.9, 2.8, 3.7, 4.7]
PROTEIN = [1.6, 3.2, 4.8, 6.4, 8]
SOLID_LETTERS = [(-1, "A"), (2, "B"), (10, "C"), (18, "D")]
DRINK_LETTERS = [(1, "B"), (5, "C"), (9, "D")]
# ---- end of fixed values ------------------------------------------------------------------------

INPUTS = ["calories", "protein", "fat", "saturated_fat", "fiber", "sodium", "sugar", "fvno"]


def nutri_score(df: DataFrame) -> DataFrame:
    """Points, letter and scaled score per product; row-local, no shuffle.

    Expects the nutrient columns of ``INPUTS`` per 100 g and the flags ``drinks``, ``cheese``, ``fat_oil``.
    A missing nutrient counts as 0.
    """
    v = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in INPUTS}
    drink = F.col("drinks") == "Drinks"
    either = lambda d, s: F.when(drink, d).otherwise(s)
    kj = v["calories"] * KJ_PER_KCAL
    at_least = lambda x, cuts: sum(((x >= c).cast("int") for c in cuts[1:]), (x >= cuts[0]).cast("int"))
    ratio = F.try_divide(v["saturated_fat"], v["fat"])
    df = df.select(
        "*",
        either(points_above(kj, DRINK_ENERGY), points_above(kj, SOLID_ENERGY)).alias("energy_points"),
        either(points_above(v["sugar"], DRINK_SUGAR), points_above(v["sugar"], SOLID_SUGAR)).alias("sugar_points"),
        points_above(v["saturated_fat"], SATURATED_FAT).alias("saturated_points"),
        points_above(v["sodium"], SODIUM).alias("sodium_points"),
        at_least(ratio, FAT_RATIO).alias("fat_ratio_points"),
        either(points_above(v["fvno"], FVNO, DRINK_FVNO_POINTS), points_above(v["fvno"], FVNO, SOLID_FVNO_POINTS)).alias("fvno_points"),
        either(points_above(v["fiber"], DRINK_FIBER), points_above(v["fiber"], SOLID_FIBER)).alias("fiber_points"),
        points_above(v["protein"], PROTEIN).alias("protein_points"),
    )
    negative = F.col("energy_points") + F.col("sugar_points") + F.col("saturated_points") + F.col("sodium_points")
    df = df.withColumn("negative_points", negative)
    positive = F.col("fiber_points") + F.col("fvno_points") + F.col("protein_points")
    full = F.col("negative_points") - positive
    # protein does not count for a product with many negative points, unless it is mostly fruit or a cheese
    limited = F.when(
        (F.col("negative_points") >= 11) & (F.col("fvno_points") < 5), F.col("negative_points") - F.col("fiber_points") - F.col("fvno_points")
    ).otherwise(full)
    fat = (
        F.col("energy_points") + F.col("sugar_points") + F.col("fat_ratio_points") + F.col("sodium_points")
        - F.col("fiber_points") - F.col("protein_points")
    )
    points = (
        F.when(drink, limited).when(F.col("fat_oil") == "Fats.Oils", fat).when(F.col("cheese") == "Cheese", full).otherwise(limited)
    )
    df = df.withColumn("score_points", points)

    def letter(cuts: list):
        out = F.when(F.col("score_points").isNotNull(), "E")
        for cut, name in reversed(cuts):
            out = F.when(F.col("score_points") <= cut, name).otherwise(out)
        return out

    water = F.coalesce(F.col("product_name").rlike("(?i)water"), F.lit(False))
    return df.withColumn(
        "score_letter", F.when(drink & water, "A").when(drink, letter(DRINK_LETTERS)).otherwise(letter(SOLID_LETTERS))
    ).withColumn("score_scaled", (F.col("score_points") + 15) / F.lit(55.0))
