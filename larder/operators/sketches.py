"""Mergeable summaries: distinct counts and quantiles of partitions, stored once and put together for any union of them.

A row of summaries holds, for one group and one column, counts, sums and extremes, a sketch of distinct values and one of
quantiles. They are as large for a billion rows as for a thousand, and merging loses nothing against sketching the union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the distinct sketch (2 ** LOG registers) and of the quantile sketch.
LOG, K = 14, 400
#: Bounds at three standard errors (distinct, as a share) and at 99 % (quantiles, as a share of the ranks).
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / (1 << LOG) ** 0.5, 2 / K


def sketched(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per group and column: n, nulls, sum, squares, least, most, distinct (sketch), quantiles (sketch); for numbers."""
    value = lambda c: F.col(c).cast("double")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("v")) for c in columns])
    long = df.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.column", "x.v")
    return long.groupBy(*keys, "column").agg(
        F.count("v").alias("n"), F.sum(F.col("v").isNull().cast("long")).alias("nulls"), F.sum("v").alias("sum"), F.sum(F.col("v") * F.col("v")).alias("squares"), F.min("v").alias("least"), F.max("v").alias("most"),
        F.hll_sketch_agg(F.when(F.col("v").isNotNull(), F.xxhash64("v")), F.lit(LOG)).alias("distinct"), F.kll_sketch_agg_double("v", F.lit(K)).alias("quantiles"),
    )


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The summaries of coarser groups (or of the whole, without keys) from those of finer ones or of several extracts."""
    return sketches.groupBy(*keys, "column").agg(
        *[F.sum(c).alias(c) for c in ("n", "nulls", "sum", "squares")], F.min("least").alias("least"), F.max("most").alias("most"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )


def described(sketches: DataFrame, keys: list[str], quantiles: list[float] = [0.25, 0.5, 0.75]) -> DataFrame:  # noqa: B006
    """Count, share of nulls, mean, sd, extremes, distinct values and quantiles (``q25`` for 0.25) of each group and column."""
    n = F.col("n").cast("double")
    spread = F.sqrt(F.greatest(F.try_divide(F.col("squares") - F.try_divide(F.col("sum") * F.col("sum"), n), n - 1), F.lit(0.0)))
    at = lambda q: F.when(n > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(q)))).alias(f"q{round(100 * q)}")
    # null counts as no value
    values: Column = F.hll_sketch_estimate("distinct")
    return sketches.select(*keys, "column", "n", F.try_divide(F.col("nulls"), F.col("n") + F.col("nulls")).alias("null_share"), F.try_divide("sum", n).alias("mean"), F.when(n > 1, spread).alias("sd"), "least", "most", values.alias("distinct"), *map(at, quantiles))
