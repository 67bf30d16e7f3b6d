"""Ingest of two product databases into one product table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import cleaning, columns, foods, labels
from larder.operators.language import UNDETERMINED, detect_languages
from larder.operators.ordering import surrogate_id
from larder.operators.relational import evaluated_once, keep_first, minimum_frequency
from larder.session import reliable_checkpoint

DATE_PREFIX = "29112024"
EXCLUDED = ["Alcoholic Beverages", "Not Food"]


def open_products(raw: DataFrame, profile: DataFrame, min_per_country: int = 1000) -> DataFrame:
    """Open product data: one row per product and country, frequent countries only, first of equal products.

    Adds an id and the translation route; ``raw`` needs ``product_name``, ``ingredients_text``, ``countries``.
    """
    df = raw.na.fill("", ["product_name", "ingredients_text", "countries"])
    df = df.where("trim(product_name) <> '' AND countries <> ''")
    df = df.withColumn("country", F.explode(F.split("countries", ","))).drop("countries")
    df = minimum_frequency(df, ["country"], min_per_country)
    df = df.withColumn("__name", F.lower("product_name"))
    keys = ["__name", "ingredients_text", "country"]
    df = keep_first(df, keys, [F.col("product_name"), *[F.col(c) for c in df.columns if c not in (*keys, "product_name")]])
    df = reliable_checkpoint(surrogate_id(df, keys, DATE_PREFIX).drop("__name"))
    # what the route asks of the text is told before the languages are joined, so that texts are not shuffled for it
    df = df.withColumn("__begin", F.substring("ingredients_text", 1, 1))
    df = detect_languages(df, "product_id", profile, {"ingredients_text": "ingredients_language", "product_name": "name_language"})
    route = foods.language_route(F.col("ingredients_language"), F.col("name_language"), F.col("__begin"))
    # English names over foreign ingredients belong to no route
    return df.withColumn("route", route).drop("__begin").where("route IS NOT NULL")


def cleaned_open(df: DataFrame, text: str) -> DataFrame:
    """All cleaning stages of open data; texts with unusable characters are dropped."""
    t = F.col(text)
    df = evaluated_once(df, {text: cleaning.clean_ingredients(F.coalesce(t, F.lit("")))})
    df = evaluated_once(df, {text: cleaning.drop_origin_clauses(t)})
    df = df.withColumn("__route", cleaning.quality_route(t)).where("__route <> 'discard'").drop("__route")
    df = df.withColumn(text, cleaning.correct_structure(t))
    df = df.withColumn(text, cleaning.drop_organic_origin(cleaning.drop_traces(t)))
    return df.withColumn(text, cleaning.translate_terms(t))


def with_nutrients(df: DataFrame, nutrients: list[str] = labels.NUTRIENTS) -> DataFrame:
    """Value and unit of each printed nutrient."""
    for n in [n for n in nutrients if n in df.columns]:
        parsed = labels.nutrient(F.col(n).cast("string"), energy=n.startswith("energy"))
        df = df.withColumn("__n", parsed).withColumn(f"{n}_value", F.col("__n.value")).withColumn(f"{n}_unit", F.col("__n.unit")).drop("__n")
    return df


def product_table(open_data: DataFrame, shop_data: DataFrame) -> DataFrame:
    """Both databases under one set of columns, with a country group.

    Both need ``product_id``, ``product_name``, ``ingredients_text``, ``store``, ``serving_size`` and the classes
    ``department``, ``aisle``, ``shelf``; open data also ``country``, shop data ``serving_size_unit`` and
    ``serving_size_value``.
    """
    o = cleaned_open(open_data.where(~F.col("department").isin(EXCLUDED)), "ingredients_text")
    o = with_nutrients(o).withColumn("serving_size_unit", labels.serving_unit(F.col("serving_size"))).withColumn("database", F.lit("open"))
    s = shop_data.where(~F.col("department").isin(EXCLUDED))
    s = s.withColumn("ingredients_text", cleaning.clean_ingredients(cleaning.starred_grams(F.coalesce("ingredients_text", F.lit("")))))
    s = with_nutrients(s).withColumn("country", F.lit("United Kingdom")).withColumn("database", F.lit("shop"))
    usable = F.coalesce(F.col("serving_size_unit").isin("", "g", "ml"), F.lit(True))
    s = s.withColumn("serving_size_value", F.when(usable, F.col("serving_size_value"))).withColumn("serving_size_unit", F.when(usable, F.col("serving_size_unit")).otherwise(""))
    both = o.unionByName(s, allowMissingColumns=True)
    both = both.withColumn("country_group", columns.country_group(F.col("country")))
    return both.withColumn("country", F.when(F.col("store") == "tesco ireland", "Ireland").otherwise(F.col("country")))


__all__ = ["UNDETERMINED", "cleaned_open", "open_products", "product_table", "with_nutrients"]
