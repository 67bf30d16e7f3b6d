"""Production and bilateral trade: completion, mapping, reconciliation, splitting, assembly.

All items, years and categories go through one plan as key columns.  A country matrix is kept as an edge
table (one row per non-zero cell) and only made dense on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import area_code
from larder.operators.relational import fill_from, join_null_safe, with_totals
from larder.sources import dims

MAX_COUNTRIES = 1000


def _countries(area: DataFrame) -> Column:
    """The sorted list of country codes as a one-row subquery; a country table is small by nature."""
    codes = area.agg(F.array_sort(F.collect_set("iso3")).alias("c"))
    checked = F.when(F.size("c") <= MAX_COUNTRIES, F.col("c")).otherwise(
        F.raise_error(F.lit(f"more than {MAX_COUNTRIES} countries")).cast("array<int>")
    )
    return codes.select(checked).scalar()


def complete_countries(df: DataFrame, area: DataFrame, groups: list[str], key: str, value: str) -> DataFrame:
    """One row per group and country, 0 where the fact table has none."""
    full = df.select(*groups).distinct().withColumn(key, F.explode(_countries(area)))
    out = full.join(df.groupBy(*groups, key).agg(F.sum(value).alias(value)), [*groups, key], "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def country_grid(edges: DataFrame, area: DataFrame, groups: list[str], value: str = "qty") -> DataFrame:
    """The dense exporter x importer form of an edge table: missing cells and the diagonal are 0."""
    codes = _countries(area)
    full = edges.select(*groups).distinct().withColumn("exporter", F.explode(codes)).withColumn("importer", F.explode(codes))
    sums = edges.where("exporter <> importer").groupBy(*groups, "exporter", "importer").agg(F.sum(value).alias(value))
    return full.join(sums, [*groups, "exporter", "importer"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def production(df: DataFrame, area: DataFrame, factors: DataFrame | None = None, milling: dict[str, float] | None = None) -> DataFrame:
    """Production per item, year and country in crop equivalents, complete over countries."""
    out = complete_countries(df, area, ["item", "yr"], "iso3", "production")
    if factors is not None:
        out = fill_from(out, factors.select("item", "crop_factor"), ["item"], "crop_factor", 1.0)
        out = out.withColumn("production", F.col("production") * F.col("crop_factor")).drop("crop_factor")
    for item, share in (dims.MILLING if milling is None else milling).items():
        out = out.withColumn("production", F.when(F.col("item") == item, F.col("production") * share).otherwise(F.col("production")))
    return out


def pooled_production(df: DataFrame, area: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """Production of categories that pool several items (fish, crustaceans)."""
    pool = dims.pairs(df.sparkSession, categories, "category", "item")
    pooled = df.join(pool, "item").groupBy("category", "yr", "iso3").agg(F.sum("production").alias("production"))
    return complete_countries(pooled, area, ["category", "yr"], "iso3", "production")


def mapped_trade(
    trade: DataFrame, items: dict[str, list[str]], trade_factors: DataFrame, crop_factors: DataFrame,
    sugar: tuple[list[str], float] | None = None, unit: str = "t",
) -> DataFrame:
    """Reports of traded goods as reports of main items: mapped, converted by both factors and added up.

    A good may belong to several main items.  ``sugar`` names the sugar crops and the factor that replaces
    the crop factor of their refined goods.
    """
    pool = dims.pairs(trade.sparkSession, items, "main_item", "item")
    t = trade.where(F.col("unit") == unit).join(pool, "item")
    t = fill_from(t, trade_factors.select("item", "factor"), ["item"], "factor", 1.0)
    t = fill_from(t, crop_factors.select("item", "crop_factor"), ["item"], "crop_factor", 1.0)
    crop = F.col("crop_factor")
    if sugar:
        crops, refined = sugar
        crop = F.when(F.col("main_item").isin(crops), F.when(F.col("item").isin(crops), 1.0).otherwise(refined)).otherwise(crop)
    return t.withColumn("value", F.col("value") * F.col("factor") * crop)


def add_up_reports(t: DataFrame) -> DataFrame:
    """Reports per main item, year, element, reporter and partner."""
    keys = [F.col("main_item").alias("item"), "yr", "element", "unit", "reporter", "partner"]
    return t.groupBy(*keys).agg(F.sum("value").alias("value"))


def split_shared_goods(t: DataFrame, production: DataFrame, crops: list[str], shared: list[str]) -> DataFrame:
    """Divide goods made from several crops by the crop shares of the country they come from.

    That is the reporter of an export and the partner of an import; a country that grows none counts 0.
    """
    grown = production.where(F.col("item").isin(crops)).groupBy("yr", "iso3", "item").agg(F.sum("production").alias("p"))
    grown = with_totals(grown, ["yr", "iso3"], total=F.sum("p")).where("total <> 0")
    share = grown.select("yr", F.col("iso3").alias("__origin"), F.col("item").alias("main_item"), (F.col("p") / F.col("total")).alias("__share"))
    origin = F.when(F.col("element") == "Export Quantity", area_code(F.col("reporter"))).otherwise(area_code(F.col("partner")))
    t = t.withColumn("__origin", origin).join(share, ["yr", "__origin", "main_item"], "left")
    divided = F.col("main_item").isin(crops) & F.col("item").isin(shared)
    value = F.when(divided, F.col("value") * F.coalesce(F.col("__share"), F.lit(0.0))).otherwise(F.col("value"))
    return t.withColumn("value", value).drop("__origin", "__share")


def match_reports(trade: DataFrame) -> DataFrame:
    """Import and export reports of the same flow side by side, by swapping roles instead of a self-join."""
    is_import = F.col("element") == "Import Quantity"
    flow = trade.where(F.col("element").isin("Import Quantity", "Export Quantity")).select(
        "item", "yr", F.when(is_import, F.col("reporter")).otherwise(F.col("partner")).alias("importer"),
        F.when(is_import, F.col("partner")).otherwise(F.col("reporter")).alias("exporter"), is_import.alias("imp"), "value",
    )
    zero = F.lit(0.0)
    return flow.groupBy("item", "yr", "importer", "exporter").agg(
        F.sum(F.when(F.col("imp"), F.col("value")).otherwise(zero)).alias("import_rep"),
        F.sum(F.when(~F.col("imp"), F.col("value")).otherwise(zero)).alias("export_rep"),
    )


def accuracy_level(import_rep: Column, export_rep: Column, small: float = 10.0) -> Column:
    """0 when both reports agree, 2 when one is missing, -1 when a missing report is about a small flow."""
    level = F.try_divide(2 * F.abs(import_rep - export_rep), import_rep + export_rep)
    return F.when((level == 2) & (import_rep < small) & (export_rep < small), -1.0).otherwise(level)


def reconcile(reports: DataFrame, good: float = 0.2) -> DataFrame:
    """One quantity per flow: the report of the more reliable partner, the importer's on a tie.

    A partner is as reliable as the share of its reported quantity that agrees with the other side.
    """
    r = reports.where("import_rep <> 0 OR export_rep <> 0").withColumn("accuracy", accuracy_level(F.col("import_rep"), F.col("export_rep")))

    def index(value: str) -> Column:
        agreed = F.sum(F.when((F.col("accuracy") != -1) & (F.col("accuracy") <= good), F.col(value)))
        return F.coalesce(F.try_divide(F.coalesce(agreed, F.lit(0.0)), F.sum(F.when(F.col("accuracy") != -1, F.col(value)))), F.lit(0.0))

    r = with_totals(r, ["item", "yr", "importer"], rim=index("import_rep"))
    r = with_totals(r, ["item", "yr", "exporter"], rix=index("export_rep"))
    return r.withColumn("qty", F.when(F.col("rim") >= F.col("rix"), F.col("import_rep")).otherwise(F.col("export_rep")))


def fish_flows(trade: DataFrame, commodities: DataFrame, countries: DataFrame, area: DataFrame) -> DataFrame:
    """Imports of fish and crustaceans as edges between listed countries.

    Only import reports count: re-exports are traced later.  Commodity classes from 38 on are feed and the
    like; 36 is crustaceans.
    """
    kind = F.when((F.col("commodity_class") >= 36) & (F.col("commodity_class") < 37), "crustaceans").otherwise("fish")
    t = trade.join(commodities, "commodity").where("commodity_class < 38 AND flow = 'I'").withColumn("category", kind)
    t = t.groupBy("category", "yr", "reporter", "partner").agg(F.sum("value").alias("qty"))
    for role, column in (("reporter", "importer"), ("partner", "exporter")):
        t = t.join(countries.select(F.col("un_code").alias(role), F.col("iso3").alias(column)), role)
    known = area.select("iso3")
    t = t.join(known.withColumnRenamed("iso3", "importer"), "importer").join(known.withColumnRenamed("iso3", "exporter"), "exporter")
    return t.where("importer <> exporter").groupBy("category", "yr", "exporter", "importer").agg(F.sum("qty").alias("qty"))


def uses(supply_use: DataFrame, keys: list[str], elements: list[str] = dims.USE_ELEMENTS) -> DataFrame:
    """Supply-and-use in wide form: the processed quantity and the domestic supply (all uses, at least 0)."""
    means = supply_use.where(F.col("element").isin(elements)).groupBy(*keys, "item", "element").agg(F.avg("value").alias("value"))
    wide = means.groupBy(*keys, "item").agg(
        F.sum(F.when(F.col("element") == "Processed", F.col("value")).otherwise(0.0)).alias("processed"), F.sum("value").alias("supply")
    )
    return wide.withColumn("supply", F.greatest(F.col("supply"), F.lit(0.0)))


def processed_share(supply_use: DataFrame, area: DataFrame, items: dict[str, tuple[list[str], list[str]]], processed: bool = True) -> DataFrame:
    """Share of each item that is processed (or not), per year and country, within 0 and 1.

    ``items`` maps an item to the goods it is made of and to the goods whose supply is no processing.
    """
    roles = [(i, g, 1) for i, (base, _) in items.items() for g in base] + [(i, g, 0) for i, (_, off) in items.items() for g in off]
    role = supply_use.sparkSession.createDataFrame(roles, "main_item string, item string, base int")
    u = uses(supply_use.withColumn("iso3", area_code(F.col("area_code"))), ["iso3", "yr"]).join(role, "item")
    base = F.col("base") == 1
    s = u.groupBy("main_item", "yr", "iso3").agg(
        F.sum(F.when(base, F.col("processed")).otherwise(-F.col("supply"))).alias("__made"),
        F.sum(F.when(base, F.col("supply")).otherwise(0.0)).alias("__supply"),
    )
    full = s.select("main_item", "yr").distinct().withColumn("iso3", F.explode(_countries(area)))
    s = full.join(s, ["main_item", "yr", "iso3"], "left")
    share = F.least(F.greatest(F.coalesce(F.try_divide(F.greatest(F.col("__made"), F.lit(0.0)), F.col("__supply")), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return s.select(F.col("main_item").alias("item"), "yr", "iso3", (share if processed else 1 - share).alias("share"))


def assemble_categories(df: DataFrame, categories: dict[str, list[str]], keys: list[str], value: str, years: list[int],
                        share: DataFrame | None = None, origin: str = "iso3") -> DataFrame:
    """Per category: items added up, then the mean over the years (a missing year counts 0).

    ``share`` scales an item by a share of its country of origin before it is added.
    """
    pool = dims.pairs(df.sparkSession, categories, "category", "item")
    t = df.where(F.col("yr").isin(years)).join(pool, "item")
    if share is not None:
        s = share.select("item", "yr", F.col("iso3").alias(origin), F.col("share").alias("__share"))
        t = join_null_safe(t, s, ["item", "yr", origin]).withColumn(value, F.col(value) * F.coalesce(F.col("__share"), F.lit(1.0)))
    return t.groupBy("category", *keys).agg((F.sum(value) / len(years)).alias(value))


def processing_factors(supply_use: DataFrame, formulas: dict[str, tuple[list[tuple[str, str, int]], list[tuple[str, str]]]],
                       world: Column, years: list[int]) -> DataFrame:
    """Crop needed per unit of product, from world totals: sums of listed goods over sums of listed goods.

    A formula lists ``(good, measure, sign)`` above and ``(good, measure)`` below the line, measures being
    'supply' or 'processed'.  An empty formula means a factor of 1.
    """
    spark = supply_use.sparkSession
    terms = [(i, "up", g, m, s) for i, (up, _) in formulas.items() for g, m, s in up]
    terms += [(i, "down", g, m, 1) for i, (_, down) in formulas.items() for g, m in down]
    table = spark.createDataFrame(terms, "product string, side string, item string, measure string, sign int")
    totals = uses(supply_use.where(world & F.col("yr").isin(years)), [])
    t = totals.join(table, "item").withColumn("v", F.when(F.col("measure") == "supply", F.col("supply")).otherwise(F.col("processed")) * F.col("sign"))
    out = t.groupBy("product").agg(
        F.sum(F.when(F.col("side") == "up", F.col("v"))).alias("up"), F.sum(F.when(F.col("side") == "down", F.col("v"))).alias("down")
    )
    out = out.select(F.col("product").alias("item"), F.try_divide("up", "down").alias("crop_factor"))
    fixed = [(i, 1.0) for i, (up, _) in formulas.items() if not up]
    out = out.unionByName(spark.createDataFrame(fixed, "item string, crop_factor double")) if fixed else out
    own = totals.select("item", "supply")
    return out.join(own, "item", "left")


def regional_uses(supply_use: DataFrame, regions: DataFrame, elements: list[str] = dims.USE_ELEMENTS) -> DataFrame:
    """Uses added up over the countries of a region: one column per element."""
    u = supply_use.where(F.col("element").isin(elements)).withColumn("iso3", area_code(F.col("area_code")))
    u = u.groupBy("iso3", "item", "element").agg(F.avg("value").alias("value")).join(regions, "iso3")
    return u.groupBy("region", "item").pivot("element", elements).agg(F.sum("value")).na.fill(0.0, elements)
