"""From labelled vectors to stored models, and from stored models to gated predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import metrics
from larder.operators.classify import Levels
from larder.operators.ordering import split_flag

GATE = 0.8
# ---- fixed values -------------------------------------------------------------------------------
LEAVES = [
    "Savoury Snacks", "Alcoholic Beverages", "Nuts and Seeds", "Not Food", "Dietary Supplements", "Artificial Sweeteners",
    "Commercial Toddlers Foods and Drinks",
]
# ---- end of fixed values ------------------------------------------------------------------------
LABELS = ["parent", "main", "sub"]


def store_models(labelled: DataFrame, path: str, leaves: list[str] = LEAVES) -> None:
    """Fit the parent model and a model of ``sub`` for each parent, and write them to ``path``.

    ``labelled``: ``embedding``, ``parent`` and ``sub``.
    """
    Levels.fit(labelled, "parent", "sub", leaves).save(labelled.sparkSession, path)


def predictions(products: DataFrame, labelled: DataFrame, path: str, gate: float = GATE) -> DataFrame:
    """Products with ``parent``, ``main``, ``sub``, their probabilities and whether both levels pass the gate.

    The models come from ``path``.  ``main`` is the group that the labels give a sub-group of that parent (the first by
    name where they give several); a parent without a model below stands for all three.
    """
    scored = Levels.load(products.sparkSession, path).predict(products.drop(*LABELS), "parent", "sub")
    mains = labelled.where("main IS NOT NULL").groupBy(F.col("parent").alias("parent_pred"), F.col("sub").alias("sub_pred")).agg(F.min("main").alias("__main"))
    out = scored.join(mains, ["parent_pred", "sub_pred"], "left")
    alone = (F.col("parent_pred") == F.col("sub_pred")) & F.col("sub_pred_prob").isNull()
    ok = metrics.confident(F.col("parent_pred_prob"), F.col("sub_pred_prob"), gate)
    return out.select(
        *[c for c in products.columns if c not in LABELS], F.col("parent_pred").alias("parent"),
        F.when(alone, F.col("parent_pred")).otherwise(F.col("__main")).alias("main"), F.col("sub_pred").alias("sub"),
        F.col("parent_pred_prob").alias("parent_prob"), F.col("sub_pred_prob").alias("sub_prob"), F.coalesce(ok, F.lit(False)).alias("confident"),
    )


def held_out(labelled: DataFrame, key: str, path: str, leaves: list[str] = LEAVES, gate: float = GATE) -> tuple[DataFrame, DataFrame]:
    """Metrics of ``parent`` and ``sub`` on a fifth of the labels that the models at ``path`` were not fitted on, and their gated coverage."""
    flagged = labelled.withColumn("__part", split_flag([key]))
    train, test = (flagged.where(F.col("__part") == p).drop("__part") for p in ("train", "test"))
    store_models(train, path, leaves)
    said = Levels.load(labelled.sparkSession, path).predict(test, "parent", "sub")
    by_level = [metrics.classification_metrics(said.where(F.col(c).isNotNull()), c, f"{c}_pred").withColumn("level", F.lit(c)) for c in ("parent", "sub")]
    return by_level[0].unionByName(by_level[1]), metrics.coverage(said, "parent_pred_prob", "sub_pred_prob", gate)
