"""Grouped summaries.  Everything is combined map-side first, so hot groups cost one row per task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.ordering import exact_quantiles_by
from larder.operators.relational import with_totals

# ---- fixed values: 97.5% points of Student's t for 1..10 degrees of freedom ----------------------
T_975 = [
    12.706204736174698, 4.302652729749462, 3.182446305284263, 2.7764451051977934, 2.570581835636314,
    2.446911851144969, 2.3646242515927844, 2.306004135204166, 2.2621571628540993, 2.2281388519649385,
]
Z_975 = 1.959963984540054
# ---- end of fixed values ------------------------------------------------------------------------


def t_975(freedom: Column) -> Column:
    """97.5% point of Student's t: listed for few degrees of freedom, else its expansion around the normal."""
    z, n = Z_975, freedom.cast("double")
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    series = reduce(lambda a, b: a + b, [F.lit(t) / F.pow(n, F.lit(i + 1)) for i, t in enumerate(terms)], F.lit(z))
    listed = F.get(F.array(*[F.lit(t) for t in T_975]), freedom.cast("int") - 1)
    return F.when(freedom >= 1, F.coalesce(listed, series))


def mean_with_interval(df: DataFrame, keys: list[str], columns: list[str], n: int | None = None, also: Sequence[Column] = ()) -> DataFrame:
    """Mean, standard error and 95% t-interval per group; ``n`` overrides the number of observations, ``also`` adds aggregates."""
    aggs = [F.count("*").alias("n"), *also]
    for c in columns:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"__sd_{c}")]
    out = df.groupBy(*keys).agg(*aggs)
    count = F.lit(n) if n else F.col("n")
    for c in columns:
        out = out.withColumn(f"se_{c}", F.col(f"__sd_{c}") / F.sqrt(count.cast("double"))).drop(f"__sd_{c}")
        half = t_975(count - 1) * F.col(f"se_{c}")
        out = out.withColumn(f"lower_ci_{c}", F.col(f"mean_{c}") - half).withColumn(f"upper_ci_{c}", F.col(f"mean_{c}") + half)
    return out


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency table, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal-width bin 1..bins; the last bin includes ``high``."""
    place = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)) + 1, F.lit(bins)).cast("int")
    kept = df.where(F.col(column).between(low, high))
    return kept.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, share of nulls, mean, sd, extremes and exact quartiles of each numeric column, from two passes for all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(F.explode(pairs).alias("x")).select("x.*")
    base = long.groupBy("column").agg(
        F.count("v").alias("n"), F.avg(F.col("v").isNull().cast("double")).alias("null_share"), F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"),
    )
    q = exact_quantiles_by(long, "column", "v", [0.25, 0.5, 0.75])
    picked = [F.max(F.when(F.col("probability") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))]
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string").join(base, "column", "left")  # an empty table has its columns too
    return every.withColumn("n", F.coalesce("n", F.lit(0))).join(q.groupBy("column").agg(*picked), "column", "left")


def shares(df: DataFrame, keys: list[str], weight: str, target: float = 100.0, out: str = "share") -> DataFrame:
    """Scale weights so that each group sums to ``target``."""
    df = with_totals(df, keys, __total=F.sum(weight))
    return df.withColumn(out, F.try_divide(F.col(weight), F.col("__total")) * target).drop("__total")


def weighted_mean(df: DataFrame, keys: list[str], columns: list[str], weight: str) -> DataFrame:
    """Sum of value times weight over sum of weights."""
    total = F.sum(weight)
    return df.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(c) * F.col(weight)), total).alias(c) for c in columns])


def scaled_by_max(df: DataFrame, columns: list[str], factor: float = 1.0, prefix: str = "", suffix: str = "_scaled",
                  among: Column | None = None) -> DataFrame:
    """Divide columns by their maximum, optionally the maximum among some rows only.

    The maxima are fetched as numbers, one row of a single aggregation.
    """
    seen = df if among is None else df.where(among)
    tops = seen.agg(*[F.max(c).alias(c) for c in columns]).first()
    return df.withColumns({f"{prefix}{c}{suffix}": F.try_divide(F.col(c), F.lit(tops[c])) * factor for c in columns})


def supported_mean(df: DataFrame, keys: list[str], pos: str, percent: str, at_least: int = 10, count_all: bool = False,
                   strictly_more: bool = False) -> DataFrame:
    """Mean percentage per group where enough observations support it and it is possible for its place."""
    counted = F.count("*") if count_all else F.sum(F.when(F.col(percent).isNotNull() & (F.col(percent) != 0), 1).otherwise(0))
    out = df.groupBy(*keys, pos).agg(F.avg(percent).alias("mean_percent"), counted.alias("__n"))
    enough = F.col("__n") > at_least if strictly_more else F.col("__n") >= at_least
    possible = F.when(F.col("mean_percent") <= F.lit(100.0) / F.col(pos), F.col("mean_percent"))
    return out.where(enough).withColumn("mean_percent", possible).drop("__n")


def position_means(df: DataFrame, pos: str, percent: str, levels: list[str]) -> DataFrame:
    """Average printed percentage by place at every level of a hierarchy, in one pass (grouping sets).

    ``levels`` runs from the coarsest to the finest; a column that a level does not use is NULL.
    """
    sets = [[F.col(c) for c in levels[: i + 1]] + [F.col(pos)] for i in range(len(levels))]
    out = df.groupingSets(sets, *[F.col(c) for c in levels], F.col(pos)).agg(
        F.avg(percent).alias("mean_percent"), F.count(percent).alias("n"), F.grouping_id().alias("__gid")
    )
    # NULL columns are the right-most ones: 0 = finest level
    depth = F.lit(len(levels)) - F.bit_count(F.col("__gid"))
    return out.withColumn("depth", depth.cast("int")).drop("__gid")


def children(df: DataFrame, parent: str, child: str) -> DataFrame:
    """Distinct children per parent as a sorted list; duplicates go before the lists are built."""
    return df.select(parent, child).distinct().groupBy(parent).agg(F.array_sort(F.collect_list(child)).alias("children"))


def two_step_sum(df: DataFrame, keys: list[str], value: str, amount: str) -> DataFrame:
    """Average repeated values within a group first, then add up the averages."""
    once = df.groupBy(*keys, value).agg(F.avg(amount).alias(amount))
    return once.groupBy(*keys).agg(F.sum(amount).alias(amount))


def product_of(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Product per group through logarithms."""
    return df.groupBy(*keys).agg(*[F.exp(F.sum(F.ln(c))).alias(c) for c in columns])


def proportions(df: DataFrame, product: list[str], part: list[str], columns: list[str]) -> DataFrame:
    """Share of each part in its product's total, for several columns at once.

    Sums are exact decimals, so that a share doesn't depend on the order of the rows.
    """
    per_part = df.groupBy(*product, *part).agg(*[F.sum(F.col(c).cast("decimal(28,12)")).alias(c) for c in columns])
    totals = with_totals(per_part, product, **{f"__t_{c}": F.sum(c) for c in columns})
    return totals.select(*product, *part, *[F.try_divide(F.col(c).cast("double"), F.col(f"__t_{c}").cast("double")).alias(c) for c in columns])


def best_of(columns: list[str]) -> tuple[Column, Column]:
    """Smallest value across columns and the name of the first column that has it."""
    smallest = F.least(*columns)
    name = F.coalesce(*[F.when(F.col(c) == smallest, F.lit(c)) for c in columns])
    return smallest, name
