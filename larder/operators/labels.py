"""Assembly of training labels from several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import renamed
from larder.operators.relational import keep_first, prefer_filled, replace_rows, union_first_wins

LABEL = ["product_id", "parent", "main", "sub"]


def matched_labels(matches: DataFrame, products: DataFrame, order: list[Column]) -> DataFrame:
    """Labels given by product name: one label per name, one product per name."""
    one = keep_first(matches, ["name"], order)
    return keep_first(one.join(products, "name"), ["name"], [F.col("product_id")])


def corrected(labels: DataFrame, corrections: DataFrame, taxonomy: DataFrame, names: dict[str, str]) -> DataFrame:
    """Corrected sub-classes replace the label of their product; unknown names are left out."""
    fixed = corrections.where("sub IS NOT NULL").withColumn("sub", renamed(F.col("sub"), names)).select("product_id", "sub")
    fixed = keep_first(fixed.join(taxonomy, "sub"), ["product_id"], [F.col("sub")])
    return replace_rows(labels.select(*LABEL), fixed.select(*LABEL), ["product_id"])


def assembled_labels(sources: list[DataFrame], texts: DataFrame) -> DataFrame:
    """Labels of all sources, earlier sources first; then one label per identical product text.

    Among products with the same lower-cased name and ingredients, one with a sub-class wins.
    """
    labels = union_first_wins([s.select(*LABEL) for s in sources], ["product_id"], [F.col("sub").isNull(), F.col("sub")])
    named = labels.join(texts, "product_id")
    named = named.withColumn("__n", F.lower("name")).withColumn("__i", F.lower("ingredients"))
    return prefer_filled(named, ["__n", "__i"], "sub", [F.col("product_id")]).drop("__n", "__i")


def self_labels(labels: DataFrame, predictions: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Add confident predictions of unlabelled products to the labels."""
    sure = predictions.where(F.col("similarity") > at_least)
    return union_first_wins([labels.select("product_id", "sub"), sure.select("product_id", "sub")], ["product_id"], [F.col("sub")])
