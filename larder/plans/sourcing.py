"""From reported trade to life-cycle weights by country of supply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import area_code
from larder.operators import reexport, sourcing, trade
from larder.session import reliable_checkpoint
from larder.sources import dims


def supply_by_origin(production: DataFrame, reports: DataFrame, area: DataFrame, categories: dict[str, list[str]],
                     years: list[int] = dims.TRADE_YEARS, share: DataFrame | None = None) -> DataFrame:
    """Mean yearly supply per category, consumer and supplier, re-exports traced to their origin."""
    flows = trade.match_reports(reports.where(F.col("yr").isin(years)))
    flows = flows.withColumn("importer", area_code(F.col("importer"))).withColumn("exporter", area_code(F.col("exporter")))
    edges = reliable_checkpoint(trade.reconcile(flows).select("item", "yr", "exporter", "importer", "qty"))
    grown = trade.production(production.where(F.col("yr").isin(years)), area)
    supply = reexport.solved(grown, edges, ["item", "yr"]).drop("residual")
    out = trade.assemble_categories(supply, categories, ["origin", "consumer"], "supply", years, share, "origin")
    return out.select("category", "consumer", F.col("origin").alias("supplier"), F.col("supply").alias("qty"))


def country_weights(supply: DataFrame, lca: DataFrame, area: DataFrame, sources: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Weights of life-cycle observations per consuming country, with the coverage log."""
    return sourcing.reweight(sourcing.lca_supply(supply, sources) if sources else supply, lca, area)
