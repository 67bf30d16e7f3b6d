"""Operations along one product's ordered ingredient list."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbour_bounds(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """``min_before`` and ``max_after``: the known values a place must fit between."""
    w = Window.partitionBy(*keys).orderBy(pos)
    return df.withColumn("min_before", F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "max_after", F.max(value).over(w.rowsBetween(1, Window.unboundedFollowing))
    )


def interpolate_gaps(df: DataFrame, keys: list[str], pos: str, value: str, out: str) -> DataFrame:
    """Straight lines between known places; nothing before the first and after the last."""
    w = Window.partitionBy(*keys).orderBy(pos)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))
    df = df.withColumn("__a", F.last(known, True).over(back)).withColumn("__b", F.first(known, True).over(ahead))
    step = F.try_divide(F.col("__b.v") - F.col("__a.v"), F.col("__b.p") - F.col("__a.p"))
    line = F.when(F.col("__a.p") == F.col("__b.p"), F.col(value)).otherwise(F.col("__a.v") + step * (F.col(pos) - F.col("__a.p")))
    return df.withColumn(out, line).drop("__a", "__b")


def monotone_repair(df: DataFrame, keys: list[str], pos: str, value: str, keep: str, out: str) -> DataFrame:
    """Raise estimates so that no later ingredient exceeds an earlier one; kept values stay and bound what is before them."""
    tail = Window.partitionBy(*keys).orderBy(F.desc(pos))
    df = df.withColumn("__seg", F.sum(F.col(keep).cast("int")).over(tail.rowsBetween(Window.unboundedPreceding, 0)))
    seg = Window.partitionBy(*keys, "__seg").orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.max(value).over(seg)).drop("__seg")


def commas_before(text: Column, part: str) -> Column:
    """Place of a part in a comma-separated text, from 1."""
    return F.regexp_count(F.substring_index(text, part, 1), F.lit(",")) + 1


def _choices(n: int, k: int, at_most: int, seed: int) -> list[list[int]]:
    """``min(at_most, C(n, k))`` distinct choices of k of n places (from 1), by seeded distinct combination numbers."""
    total, rng = math.comb(n, k), random.Random(f"{seed}|{n}|{k}")
    numbers = range(total) if total <= at_most else set()
    while len(numbers) < min(at_most, total):
        numbers.add(rng.randrange(total))
    out = []
    for number in sorted(numbers):
        places, left = [], k
        for place in range(1, n + 1):
            if not left:
                break
            with_it = math.comb(n - place, left - 1)
            if number < with_it:
                places.append(place)
                left -= 1
            else:
                number -= with_it
        out.append(places)
    return out


SEED = 19


def hidden_ways(n: int, at_most: int = 100, seed: int = SEED) -> Iterator[tuple[int, list[list[int]]]]:
    """For a list of n places and every number hidden from 2 on: which places to hide, in at most ``at_most`` ways."""
    return ((k, _choices(n, k, at_most, seed)) for k in range(2, n + 1))


def hidden_positions(spark, max_items: int = 50, at_most: int = 100, seed: int = SEED) -> DataFrame:
    """Which places to hide, per list length n up to ``max_items`` and number hidden k >= 2: ``(n, k, combo, hidden)``.

    All combinations when there are at most ``at_most``, else a seeded choice of that many distinct ones.  The table
    depends on the list lengths only.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n in b["id"]:
                for k, hidden in hidden_ways(int(n), at_most, seed):
                    yield pd.DataFrame({"n": n, "k": k, "combo": range(1, len(hidden) + 1), "hidden": hidden})

    lengths = spark.range(2, max_items + 1).repartition(max(1, min(64, max_items - 1)), "id")
    return lengths.mapInPandas(listed, "n int, k int, combo int, hidden array<int>")
