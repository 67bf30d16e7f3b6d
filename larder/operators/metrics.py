"""Quality of classifications: everything follows from the table of confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str, prediction: str, keys: list[str] | None = None) -> DataFrame:
    """Counts per true and predicted class: at most classes squared rows."""
    return df.groupBy(*(keys or []), F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy, balanced accuracy, weighted precision, recall and F1, and Matthews' correlation."""
    table = confusion(df, label, prediction)
    true = table.groupBy(F.col("label").alias("k")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    said = table.groupBy(F.col("prediction").alias("k")).agg(F.sum("n").alias("p"))
    c = true.join(said, "k", "full").select("k", *[F.coalesce(F.col(x), F.lit(0)).cast("double").alias(x) for x in ("t", "hit", "p")])
    precision = F.coalesce(F.try_divide("hit", "p"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hit", "t"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    s = c.agg(
        F.sum("t").alias("s"), F.sum("hit").alias("c"), F.sum(F.col("p") * F.col("t")).alias("pt"), F.sum(F.col("p") * F.col("p")).alias("pp"),
        F.sum(F.col("t") * F.col("t")).alias("tt"), F.avg(F.when(F.col("t") > 0, recall)).alias("balanced_accuracy"),
        F.sum(precision * F.col("t")).alias("wp"), F.sum(recall * F.col("t")).alias("wr"), F.sum(f1 * F.col("t")).alias("wf"),
    )
    spread = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return s.select(
        F.try_divide("c", "s").alias("accuracy"), "balanced_accuracy", F.try_divide("wp", "s").alias("precision"),
        F.try_divide("wr", "s").alias("recall"), F.try_divide("wf", "s").alias("f1"),
        F.coalesce(F.try_divide(F.col("c") * F.col("s") - F.col("pt"), spread), F.lit(0.0)).alias("mcc"),
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_c"))
    n, k = counts.agg(F.sum("n_c")).scalar(), counts.agg(F.count("*")).scalar()
    return counts.select(label, (n / (k * F.col("n_c"))).alias("weight"))


def confident(p0: Column, p2: Column, gate: float = 0.8) -> Column:
    """Both levels predicted with confidence, or the upper one where there is no lower."""
    return (p0 > gate) & (p2.isNull() | (p2 > gate))


def coverage(df: DataFrame, p0: str, p2: str, gate: float = 0.8) -> DataFrame:
    """How many predictions pass both gates."""
    ok = F.coalesce(confident(F.col(p0), F.col(p2), gate), F.lit(False))
    return df.agg(F.count("*").alias("n"), F.sum(ok.cast("bigint")).alias("confident"), F.avg(ok.cast("double")).alias("share"))


def agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How two models agree: on both levels, on the upper only, or not; with their mean confidence."""
    both = a.join(b.withColumnsRenamed({c: f"{c}_b" for c in b.columns if c != key}), key)
    both = both.withColumn("agree0", F.col("level0") == F.col("level0_b")).withColumn("agree2", F.col("level2") == F.col("level2_b"))
    return both.groupBy("agree0", "agree2").agg(F.count("*").alias("n"), F.avg("p0").alias("p0"), F.avg("p0_b").alias("p0_b"))


def label_score(label: Column, prediction: Column) -> Column:
    """1 for a right prediction, 0 for a wrong one, NULL without a label."""
    return F.when(label.isNotNull(), F.coalesce(label == prediction, F.lit(False)).cast("int"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
