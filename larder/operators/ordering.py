"""Ranks, batches, samples and splits that do not depend on file or partition order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import reliable_checkpoint


def shuffle_key(keys: list[str], seed: int = 42) -> Column:
    """A seeded hash of the keys; ordering by it is a reproducible shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def with_rank(df: DataFrame, keys: list[str], seed: int = 42, name: str = "rank", digits: int = 4) -> DataFrame:
    """Number all rows 1..N in shuffled order without a single-task sort.

    Rows fall into 16**digits even buckets by the leading digits of their hash.  Bucket sizes give each
    bucket its offset (a table of at most 16**digits rows), and rows are numbered inside their bucket.
    ``keys`` must be unique.
    """
    hashed = df.withColumn("__hash", shuffle_key(keys, seed)).withColumn("__bucket", F.substring("__hash", 1, digits))
    sizes = hashed.groupBy("__bucket").agg(F.count("*").alias("__size"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__bucket").orderBy("__hash", *keys)
    return (
        hashed.join(F.broadcast(offsets), "__bucket")  # bounded: one row per bucket
        .withColumn(name, F.col("__offset") + F.row_number().over(inside))
        .drop("__hash", "__bucket", "__offset")
    )


def surrogate_id(df: DataFrame, keys: list[str], prefix: str, name: str = "product_id") -> DataFrame:
    """An integer id: a date prefix followed by the row's number (from 0)."""
    numbered = with_rank(df, keys, name="__n")
    return numbered.withColumn(name, F.concat(F.lit(prefix), (F.col("__n") - 1).cast("string")).cast("bigint")).drop("__n")


def in_batches(df: DataFrame, keys: list[str], size: int = 500, seed: int = 42) -> DataFrame:
    """Shuffle and cut into batches of ``size`` rows, numbered from 0."""
    ranked = with_rank(df, keys, seed, "__rank")
    return ranked.withColumn("batch", F.floor((F.col("__rank") - 1) / size).cast("bigint")).drop("__rank")


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """A reproducible sample of exactly ``n`` rows (per-task top n, then a merge)."""
    return df.orderBy(shuffle_key(keys, seed), *keys).limit(n)


def split_flag(keys: list[str], train_share: float = 0.8, seed: int = 42) -> Column:
    """'train' or 'test' by hash, stable when rows are added."""
    part = F.conv(F.substring(shuffle_key(keys, seed), 1, 7), 16, 10).cast("double") / F.lit(float(16**7))
    return F.when(part < train_share, "train").otherwise("test")


def running_counts(freq: DataFrame, value: str, count: str) -> DataFrame:
    """For a table of distinct values and their counts: the number of rows below each value.

    The values are range-partitioned once and checkpointed, so the partition number is plain data; the
    offsets of the partitions are a handful of rows.
    """
    spread = freq.repartitionByRange(F.col(value)).withColumn("__part", F.spark_partition_id())
    spread = reliable_checkpoint(spread)
    sizes = spread.groupBy("__part").agg(F.sum(count).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return spread.join(F.broadcast(offsets), "__part").select(  # bounded: one row per partition
        value, count, (F.col("__offset") + F.coalesce(F.sum(count).over(inside), F.lit(0))).alias("below")
    )


def exact_quantiles_by(df: DataFrame, group: str, column: str, probabilities: list[float]) -> DataFrame:
    """Rows (group, probability, value): exact interpolated quantiles of each group by one distributed sort.

    Equal values are merged first, so that a large group is no single task.
    """
    freq = df.where(F.col(column).isNotNull()).groupBy(F.struct(F.col(group).alias("g"), F.col(column).alias("v")).alias("v")).agg(F.count("*").alias("n"))
    ranked = running_counts(freq, "v", "n").select(F.col("v.g").alias(group), "v.v", "n", "below")
    ends = ranked.groupBy(group).agg(F.min("below").alias("__first"), F.sum("n").alias("__total"))
    ranked = ranked.join(ends, group).withColumn("below", F.col("below") - F.col("__first"))
    outs = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("__total") - 1)
        for side, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            inside = (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
            outs.append(F.max(F.when(inside, F.col("v"))).alias(f"{side}{i}"))
        outs.append(F.max(place - F.floor(place)).alias(f"w{i}"))
    picked = ranked.groupBy(group).agg(*outs)
    rows = [
        F.struct(F.lit(float(p)).alias("probability"), (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}")).alias("value"))
        for i, p in enumerate(probabilities)
    ]
    return picked.select(group, F.explode(F.array(*rows)).alias("q")).select(group, "q.*")
