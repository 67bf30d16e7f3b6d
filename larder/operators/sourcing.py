"""Re-weighting of life-cycle observations by where a country's supply comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.session import reliable_checkpoint

LEVELS = ["country", "intermediate_region", "sub_region", "region", "global"]


def supply_shares(supply: DataFrame, drop_below: float = 0.1) -> DataFrame:
    """Percent of each consumer's supply by supplier; small suppliers are left out and the rest adds up to 100.

    The windows hold the suppliers of one consumer and category: at most as many rows as there are countries.
    """
    own = Window.partitionBy("consumer", "category")
    percent = F.try_divide(F.col("qty"), F.sum("qty").over(own)) * 100
    s = supply.groupBy("consumer", "category", "supplier").agg(F.sum("qty").alias("qty"))
    s = s.withColumn("share", percent).where(F.col("share") >= drop_below)
    return s.withColumn("share", percent).where("share > 0").drop("qty")


def _by_level(lca: DataFrame, area: DataFrame) -> DataFrame:
    """Observations once per level they can stand for, with their share of the level's weight."""
    placed = lca.join(area.select("iso3", *LEVELS[1:4]), "iso3")
    keys = [F.col("iso3"), F.col("intermediate_region"), F.col("sub_region"), F.col("region"), F.lit(0)]
    spots = F.array(*[F.struct(F.lit(i).alias("level"), k.cast("int").alias("place")) for i, k in enumerate(keys)])
    every = placed.select("obs_id", F.col("food_category").alias("category"), "weight", F.explode(spots).alias("s"))
    every = every.select("obs_id", "category", "weight", "s.level", "s.place").where("place IS NOT NULL")
    totals = every.groupBy("category", "level", "place").agg(F.sum("weight").alias("__t"))
    return every.join(totals, ["category", "level", "place"]).withColumn("part", F.try_divide("weight", "__t")).drop("__t", "weight")


def assigned_levels(shares: DataFrame, by_level: DataFrame, area: DataFrame) -> DataFrame:
    """The finest level at which each supplier has observations of the category, and the place there."""
    exists = by_level.select("category", "level", "place").distinct()
    s = shares.join(area.select(F.col("iso3").alias("supplier"), *LEVELS[1:4]), "supplier")
    spots = [F.col("supplier"), F.col("intermediate_region"), F.col("sub_region"), F.col("region"), F.lit(0)]
    found = []
    for i, spot in enumerate(spots):
        there = exists.where(F.col("level") == i).select("category", F.col("place").alias(f"__p{i}"), F.lit(True).alias(f"__e{i}"))
        s = s.withColumn(f"__p{i}", spot.cast("int")).join(there, ["category", f"__p{i}"], "left")
        found.append(F.when(F.col(f"__e{i}"), F.struct(F.lit(i).alias("level"), F.col(f"__p{i}").alias("place"))))
    s = s.withColumn("__at", F.coalesce(*found)).where("__at IS NOT NULL")
    return s.select("consumer", "category", "supplier", "share", "__at.level", "__at.place")


def reweight(supply: DataFrame, lca: DataFrame, area: DataFrame, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """New weights per consumer and observation, and the share that came from each level.

    Weights of a consumer and category add up to 100.  Where fewer than ``least`` observations would be left
    although the category has more, all of them count with their global weights.  Placed observations and
    assigned suppliers are each used several times and are written once.
    """
    by_level = reliable_checkpoint(_by_level(lca, area))
    levels = reliable_checkpoint(assigned_levels(supply_shares(supply), by_level, area))
    # suppliers that fall back to the same place are added up before observations are attached
    places = levels.groupBy("consumer", "category", "level", "place").agg(F.sum("share").alias("share"))
    weights = places.join(by_level, ["category", "level", "place"])
    weights = weights.groupBy("consumer", "category", "obs_id").agg(F.sum(F.col("share") * F.col("part")).alias("weight"))
    have = weights.groupBy("consumer", "category").agg(F.count("*").alias("__have"))
    # observations whose country is unknown cannot be placed at all
    whole = by_level.where("level = 4")
    exist = whole.groupBy("category").agg(F.count("*").alias("__exist"))
    few = have.join(exist, "category").where((F.col("__have") < least) & (F.col("__exist") > F.col("__have"))).select("consumer", "category")
    global_rows = few.join(whole, "category").select("consumer", "category", "obs_id", (F.col("part") * 100).alias("weight"))
    weights = weights.join(few, ["consumer", "category"], "left_anti").unionByName(global_rows)

    by = [F.coalesce(F.sum(F.when(F.col("level") == i, F.col("share"))), F.lit(0.0)).alias(f"from_{n}") for i, n in enumerate(LEVELS)]
    log = levels.groupBy("consumer", "category").agg(*by)
    log = log.join(few.withColumn("__few", F.lit(1)), ["consumer", "category"], "left")
    return weights, log.withColumn("using_global_avg", F.coalesce(F.col("__few"), F.lit(0))).drop("__few")


def lca_supply(supply: DataFrame, sources: dict[str, list[str]]) -> DataFrame:
    """Supply of trade categories as supply of life-cycle categories (one may be sourced from several)."""
    from larder.sources.dims import pairs

    pool = pairs(supply.sparkSession, sources, "lca_category", "category")
    s = supply.join(pool, "category").groupBy("consumer", F.col("lca_category").alias("category"), "supplier")
    return s.agg(F.sum("qty").alias("qty"))
