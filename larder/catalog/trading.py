"""Trade and sourcing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.catalog.registry import query, rounded, rounded_sql
from larder.fixtures import ctes, derived
from larder.operators import reexport as rx
from larder.operators import sourcing as so
from larder.operators import trade as tr


def _r(df, keys, *cols, digits=6):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in cols])


_GRID = "(SELECT g.item, g.yr, a.iso3 FROM (SELECT DISTINCT item, yr FROM production) g CROSS JOIN area a)"


@query(
    "trd01_production",
    ctes("production", "area") + f"""SELECT g.item, g.yr, g.iso3, round(coalesce(production, 0) * CASE g.item WHEN 'PROMO' THEN 1.5 ELSE 1 END * CASE g.item WHEN 'SMALL' THEN 0.7 ELSE 1 END, 6) AS production
      FROM {_GRID} g LEFT JOIN production p ON p.item = g.item AND p.yr = g.yr AND p.iso3 = g.iso3""",
)
def trd01(spark, d):
    factors = spark.createDataFrame([("PROMO", 1.5)], "item string, crop_factor double")
    out = tr.production(derived(spark, d, "production"), derived(spark, d, "area"), factors, {"SMALL": 0.7})
    return _r(out, ["item", "yr", "iso3"], "production")


FISH = {"fish": ["SMALL", "PROMO"], "crustaceans": ["LARGE"]}
_CAT = "CASE WHEN item IN ('SMALL', 'PROMO') THEN 'fish' WHEN item = 'LARGE' THEN 'crustaceans' END"


@query(
    "trd02_fish_production",
    ctes("production", "area") + f"""SELECT c.category, c.yr, a.iso3, round(coalesce(sum(p.production), 0), 6) AS production
      FROM (SELECT DISTINCT {_CAT} AS category, yr FROM production WHERE {_CAT} IS NOT NULL) c CROSS JOIN area a
      LEFT JOIN (SELECT {_CAT} AS category, * FROM production) p ON p.category = c.category AND p.yr = c.yr AND p.iso3 = a.iso3 GROUP BY 1, 2, 3""",
)
def trd02(spark, d):
    return _r(tr.pooled_production(derived(spark, d, "production"), derived(spark, d, "area"), FISH), ["category", "yr", "iso3"], "production")


ITEMS = {"Wheat": ["SMALL", "PROMO"], "Maize": ["PROMO", "LARGE"]}


@query(
    "trd03_mapped_trade",
    ctes("trade") + """, m(main_item, item) AS (VALUES ('Wheat', 'SMALL'), ('Wheat', 'PROMO'), ('Maize', 'PROMO'), ('Maize', 'LARGE'))
    SELECT main_item AS item, yr, element, unit, reporter, partner, round(sum(value * CASE t.item WHEN 'SMALL' THEN 0.5 ELSE 1 END * CASE t.item WHEN 'LARGE' THEN 2.0 ELSE 1 END), 6) AS value
    FROM trade t JOIN m ON m.item = t.item GROUP BY 1, 2, 3, 4, 5, 6""",
)
def trd03(spark, d):
    f = spark.createDataFrame([("SMALL", 0.5)], "item string, factor double")
    c = spark.createDataFrame([("LARGE", 2.0)], "item string, crop_factor double")
    out = tr.add_up_reports(tr.mapped_trade(derived(spark, d, "trade"), ITEMS, f, c))
    return _r(out, ["item", "yr", "element", "unit", "reporter", "partner"], "value")


@query(
    "trd04_split_sugars",
    ctes("trade", "production") + """, m(main_item, item) AS (VALUES ('SMALL', 'SMALL'), ('SMALL', 'PROMO'), ('LARGE', 'LARGE'), ('LARGE', 'PROMO')),
    g AS (SELECT yr, iso3, item AS crop, production, sum(production) OVER (PARTITION BY yr, iso3) AS t FROM production WHERE item IN ('SMALL', 'LARGE'))
    SELECT m.main_item AS item, t.yr, element, unit, reporter, partner, round(sum(value * CASE WHEN t.item = 'PROMO' THEN 3.0 * coalesce(g.production / g.t, 0) ELSE 1 END), 6) AS value
    FROM trade t JOIN m ON m.item = t.item LEFT JOIN g ON g.t <> 0 AND g.yr = t.yr AND g.crop = m.main_item
      AND g.iso3 = CAST(substr(CASE WHEN element = 'Export Quantity' THEN reporter ELSE partner END, 2) AS INT) GROUP BY 1, 2, 3, 4, 5, 6""",
)
def trd04(spark, d):
    none = spark.createDataFrame([], "item string, factor double, crop_factor double")
    t = tr.mapped_trade(derived(spark, d, "trade"), {"SMALL": ["SMALL", "PROMO"], "LARGE": ["LARGE", "PROMO"]}, none, none, (["SMALL", "LARGE"], 3.0))
    t = tr.split_shared_goods(t, derived(spark, d, "production"), ["SMALL", "LARGE"], ["PROMO"])
    return _r(tr.add_up_reports(t), ["item", "yr", "element", "unit", "reporter", "partner"], "value")


_AL = "2 * abs(import_rep - export_rep) / (import_rep + export_rep)"
_REC = f"""
, al AS (SELECT *, CASE WHEN {_AL} = 2 AND import_rep < 10 AND export_rep < 10 THEN -1 ELSE {_AL} END AS al FROM flow WHERE import_rep <> 0 OR export_rep <> 0)
, rel AS (SELECT *, coalesce(sum(CASE WHEN al <> -1 AND al <= 0.2 THEN import_rep ELSE 0 END) OVER i / nullif(sum(CASE WHEN al <> -1 THEN import_rep END) OVER i, 0), 0) AS rim,
      coalesce(sum(CASE WHEN al <> -1 AND al <= 0.2 THEN export_rep ELSE 0 END) OVER e / nullif(sum(CASE WHEN al <> -1 THEN export_rep END) OVER e, 0), 0) AS rix
      FROM al WINDOW i AS (PARTITION BY item, yr, importer), e AS (PARTITION BY item, yr, exporter))
, edge AS (SELECT item, yr, exporter, importer, CASE WHEN rim >= rix THEN import_rep ELSE export_rep END AS qty, rim, rix FROM rel)
"""


@query("trd05_reconcile", ctes("flow") + _REC + "SELECT item, yr, exporter, importer, round(rim, 6) AS rim, round(rix, 6) AS rix, round(qty, 6) AS qty FROM edge")
def trd05(spark, d):
    return _r(tr.reconcile(derived(spark, d, "flow")), ["item", "yr", "exporter", "importer"], "rim", "rix", "qty")


@query(
    "trd06_matrix",
    ctes("flow", "area") + _REC + """SELECT g.item, g.yr, a.iso3 AS exporter, b.iso3 AS importer, CASE WHEN a.iso3 = b.iso3 THEN 0 ELSE round(coalesce(e.qty, 0), 6) END AS qty
    FROM (SELECT DISTINCT item, yr FROM edge) g CROSS JOIN area a CROSS JOIN area b LEFT JOIN edge e ON e.item = g.item AND e.yr = g.yr AND e.exporter = a.iso3 AND e.importer = b.iso3""",
)
def trd06(spark, d):
    grid = tr.country_grid(tr.reconcile(derived(spark, d, "flow")), derived(spark, d, "area"), ["item", "yr"])
    return _r(grid, ["item", "yr", "exporter", "importer"], "qty")


@query(
    "trd07_fish_flows",
    ctes("flow") + """SELECT CASE WHEN item = 'LARGE' THEN 'crustaceans' ELSE 'fish' END AS category, yr, exporter, importer, round(sum(import_rep), 6) AS qty
    FROM flow WHERE item <> 'PROMO' AND importer <> exporter GROUP BY 1, 2, 3, 4""",
)
def trd07(spark, d):
    code = F.col("n_nationkey") * 4 + 8
    countries = derived(spark, d, "nation").select(code.alias("un_code"), F.col("n_nationkey").alias("iso3"))
    goods = spark.createDataFrame([("SMALL", 35.0), ("LARGE", 36.5), ("PROMO", 38.0), ("ECONOMY", 37.0), ("MEDIUM", 34.0), ("STANDARD", 37.5)], "commodity string, commodity_class double")
    f = derived(spark, d, "flow")
    t = f.select(F.col("item").alias("commodity"), "yr", (F.col("importer") * 4 + 8).alias("reporter"), (F.col("exporter") * 4 + 8).alias("partner"), F.lit("I").alias("flow"), F.col("import_rep").alias("value"))
    x = t.withColumn("flow", F.lit("E"))
    return _r(tr.fish_flows(t.unionByName(x), goods, countries, derived(spark, d, "area")), ["category", "yr", "exporter", "importer"], "qty")


_KEPT = "least(1.0, coalesce((grown + arrived) / nullif(wanted, 0), 1.0))"


def _re_export_sql(limit_rounds: int, rounds: int) -> str:
    sql = ctes("flow", "production").replace("WITH ", "WITH RECURSIVE ", 1) + """
    , e AS (SELECT item, yr, exporter, importer, import_rep AS qty FROM flow WHERE importer <> exporter AND import_rep > 0)
    , n0 AS (SELECT coalesce(p.item, x.item, m.item) AS item, coalesce(p.yr, x.yr, m.yr) AS yr, coalesce(p.iso3, x.iso3, m.iso3) AS iso3, coalesce(p.production, 0) AS grown, coalesce(x.q, 0) AS wanted, coalesce(m.q, 0) AS arrived
       FROM production p FULL JOIN (SELECT item, yr, exporter AS iso3, sum(qty) AS q FROM e GROUP BY 1, 2, 3) x ON x.item = p.item AND x.yr = p.yr AND x.iso3 = p.iso3
       FULL JOIN (SELECT item, yr, importer AS iso3, sum(qty) AS q FROM e GROUP BY 1, 2, 3) m ON m.item = coalesce(p.item, x.item) AND m.yr = coalesce(p.yr, x.yr) AND m.iso3 = coalesce(p.iso3, x.iso3))
    """
    for i in range(limit_rounds):
        sql += f""", n{i + 1} AS MATERIALIZED (SELECT n.item, n.yr, n.iso3, grown, wanted, coalesce(s.q, 0) AS arrived FROM n{i} n LEFT JOIN
          (SELECT e.item, e.yr, e.importer AS iso3, sum(e.qty * {_KEPT}) AS q FROM e JOIN n{i} k ON k.item = e.item AND k.yr = e.yr AND k.iso3 = e.exporter GROUP BY 1, 2, 3) s
          ON s.item = n.item AND s.yr = n.yr AND s.iso3 = n.iso3)"""
    return sql + f""", nodes AS MATERIALIZED (SELECT *, {_KEPT} AS kept, grown + arrived AS available FROM n{limit_rounds})
    , route AS (SELECT e.item, e.yr, e.exporter, e.importer, e.qty * kept / available AS leaves FROM e JOIN nodes k ON k.item = e.item AND k.yr = e.yr AND k.iso3 = e.exporter WHERE available > 0 AND kept > 0)
    , p(step, item, yr, origin, spot, amount) AS (SELECT 0, item, yr, iso3, iso3, grown::DOUBLE FROM nodes WHERE grown > 0 UNION ALL
        SELECT p.step + 1, p.item, p.yr, p.origin, r.importer, sum(p.amount * r.leaves) FROM p JOIN route r ON r.item = p.item AND r.yr = p.yr AND r.exporter = p.spot WHERE p.step < {rounds} GROUP BY ALL)
    , got AS (SELECT item, yr, origin, spot, sum(amount) AS amount FROM p GROUP BY 1, 2, 3, 4)
    , home AS (SELECT item, yr, iso3, CASE WHEN kept < 1 OR (available - wanted) / available < 1e-12 THEN 0 ELSE (available - wanted) / available END AS stays FROM nodes WHERE available > 0)
    SELECT got.item, got.yr, origin, spot AS consumer, {rounded_sql('amount * stays', 4)} AS supply FROM got JOIN home k ON k.item = got.item AND k.yr = got.yr AND k.iso3 = got.spot WHERE stays > 0"""


def _edges(spark, d):
    return derived(spark, d, "flow").select("item", "yr", "exporter", "importer", F.col("import_rep").alias("qty"))


@query("trd08_re_export", _re_export_sql(30, 80))
def trd08(spark, d):
    out = rx.solved(derived(spark, d, "production"), _edges(spark, d), ["item", "yr"])
    return out.select("item", "yr", "origin", "consumer", rounded("supply", 4))


@query("trd08_re_export_series")
def trd08_series(spark, d):
    """The series, settled, next to the solution of the system."""
    p, e, pair = derived(spark, d, "production"), _edges(spark, d), ["item", "yr", "origin", "consumer"]
    out = rx.re_export(p, e, ["item", "yr"]).join(rx.solved(p, e, ["item", "yr"]).withColumnRenamed("supply", "direct"), pair, "full")
    return out.select(*pair, "supply", "direct", "residual")


SPLITS = {"Brand#1": (["Brand#1"], ["Brand#2"]), "Brand#3": (["Brand#3", "Brand#4"], ["Brand#5", "Brand#6"]), "Brand#7": (["Brand#7"], [])}
_ROLES = ", ".join(f"('{i}', '{g}', {b})" for i, (base, off) in SPLITS.items() for b, gs in ((1, base), (0, off)) for g in gs)


@query(
    "trd09_processed_share",
    ctes("supply_use", "area") + f""", m(main_item, item, base) AS (VALUES {_ROLES}),
    u AS (SELECT CAST(substr(area_code, 2) AS INT) AS iso3, yr, item, coalesce(sum(CASE WHEN element = 'Processed' THEN value END), 0) AS processed, greatest(sum(value), 0) AS supply FROM supply_use GROUP BY 1, 2, 3),
    s AS (SELECT main_item, yr, iso3, sum(CASE WHEN base = 1 THEN processed ELSE -supply END) AS made, sum(CASE WHEN base = 1 THEN supply ELSE 0 END) AS supply FROM u JOIN m ON m.item = u.item GROUP BY 1, 2, 3)
    SELECT g.main_item AS item, g.yr, a.iso3, round(1 - least(greatest(coalesce(greatest(made, 0) / nullif(supply, 0), 0), 0), 1), 6) AS share
    FROM (SELECT DISTINCT main_item, yr FROM s) g CROSS JOIN area a LEFT JOIN s ON s.main_item = g.main_item AND s.yr = g.yr AND s.iso3 = a.iso3""",
)
def trd09(spark, d):
    return _r(tr.processed_share(derived(spark, d, "supply_use"), derived(spark, d, "area"), SPLITS, processed=False), ["item", "yr", "iso3"], "share")


CATEGORIES = {"small goods": ["SMALL", "ECONOMY"], "big goods": ["LARGE", "MEDIUM"], "all": ["SMALL", "LARGE", "PROMO"]}
_CATS = ", ".join(f"('{c}', '{i}')" for c, items in CATEGORIES.items() for i in items)


@query(
    "trd10_assemble",
    ctes("flow") + f""", m(category, item) AS (VALUES {_CATS}) SELECT category, exporter, importer, round(sum(import_rep * CASE WHEN f.item = 'SMALL' AND exporter % 2 = 0 THEN 0.25 ELSE 1 END) / 4, 6) AS qty
    FROM flow f JOIN m ON m.item = f.item WHERE yr IN (1996, 1997, 1998, 1999) GROUP BY 1, 2, 3""",
)
def trd10(spark, d):
    years = [1996, 1997, 1998, 1999]
    share = derived(spark, d, "production").where("item = 'SMALL' AND iso3 % 2 = 0").select("item", "yr", "iso3", F.lit(0.25).alias("share"))
    all_exporters = derived(spark, d, "area").where("iso3 % 2 = 0").select(F.lit("SMALL").alias("item"), F.explode(F.array(*[F.lit(y) for y in years])).alias("yr"), "iso3", F.lit(0.25).alias("share"))
    share = share.union(all_exporters).distinct()
    out = tr.assemble_categories(_edges(spark, d), CATEGORIES, ["exporter", "importer"], "qty", years, share, "exporter")
    return _r(out, ["category", "exporter", "importer"], "qty")


FORMULAS = {
    "Brand#1": ([("Brand#1", "supply", 1), ("Brand#2", "supply", 1)], [("Brand#1", "supply")]),
    "Brand#3": ([("Brand#3", "processed", 1), ("Brand#4", "supply", -1)], [("Brand#5", "supply"), ("Brand#6", "supply")]),
    "Brand#9": ([], []),
}


@query(
    "trd11_processing_factors",
    ctes("supply_use") + """, u AS (SELECT item, sum(v) AS supply, sum(CASE WHEN element = 'Processed' THEN v ELSE 0 END) AS processed FROM
      (SELECT item, element, avg(value) AS v FROM (SELECT item, element, yr, sum(value) AS value FROM supply_use GROUP BY 1, 2, 3) world WHERE yr BETWEEN 1996 AND 1999 GROUP BY 1, 2) GROUP BY 1),
    w AS (SELECT max(CASE WHEN item = 'Brand#1' THEN supply END) AS s1, max(CASE WHEN item = 'Brand#2' THEN supply END) AS s2, max(CASE WHEN item = 'Brand#3' THEN processed END) AS p3,
      max(CASE WHEN item = 'Brand#4' THEN supply END) AS s4, max(CASE WHEN item = 'Brand#5' THEN supply END) AS s5, max(CASE WHEN item = 'Brand#6' THEN supply END) AS s6, max(CASE WHEN item = 'Brand#3' THEN supply END) AS s3,
      max(CASE WHEN item = 'Brand#9' THEN supply END) AS s9 FROM u)
    SELECT 'Brand#1' AS item, round((s1 + coalesce(s2, 0)) / s1, 6) AS crop_factor, round(s1, 6) AS supply FROM w UNION ALL
    SELECT 'Brand#3', round((coalesce(p3, 0) - coalesce(s4, 0)) / (coalesce(s5, 0) + coalesce(s6, 0)), 6), round(s3, 6) FROM w UNION ALL SELECT 'Brand#9', 1.0, round(s9, 6) FROM w""",
)
def trd11(spark, d):
    world = derived(spark, d, "supply_use").groupBy("item", "element", "yr").agg(F.sum("value").alias("value")).withColumn("area_code", F.lit("world"))
    out = tr.processing_factors(world, FORMULAS, F.col("area_code") == "world", [1996, 1997, 1998, 1999])
    return _r(out, ["item"], "crop_factor", "supply")


@query(
    "trd12_regional_uses",
    ctes("supply_use", "area") + """SELECT region, item, round(sum(CASE WHEN element = 'Food' THEN v ELSE 0 END), 6) AS "Food", round(sum(CASE WHEN element = 'Feed' THEN v ELSE 0 END), 6) AS "Feed",
      round(sum(CASE WHEN element = 'Loss' THEN v ELSE 0 END), 6) AS "Loss" FROM (SELECT CAST(substr(area_code, 2) AS INT) AS iso3, item, element, avg(value) AS v FROM supply_use WHERE element IN ('Food', 'Feed', 'Loss') GROUP BY 1, 2, 3) u
      JOIN area a ON a.iso3 = u.iso3 GROUP BY 1, 2""",
)
def trd12(spark, d):
    out = tr.regional_uses(derived(spark, d, "supply_use"), derived(spark, d, "area").select("iso3", "region"), ["Food", "Feed", "Loss"])
    return _r(out, ["region", "item"], "Food", "Feed", "Loss")


# all observations, each supplier at the nearest level that has any
_SOURCED = """
, lc AS (SELECT * FROM lca)
, sup AS (SELECT importer AS consumer, item AS category, exporter AS supplier, sum(import_rep) AS qty FROM flow GROUP BY 1, 2, 3)
, s1 AS (SELECT *, qty / sum(qty) OVER (PARTITION BY consumer, category) * 100 AS sh FROM sup)
, s2 AS (SELECT consumer, category, supplier, qty / sum(qty) OVER (PARTITION BY consumer, category) * 100 AS share FROM s1 WHERE sh >= 0.1)
, la AS (SELECT lc.*, a.intermediate_region AS ir, a.sub_region AS sr, a.region AS rg FROM lc JOIN area a ON a.iso3 = lc.iso3)
, lv AS (SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM la WHERE la.food_category = s.category AND la.iso3 = s.supplier) THEN 0
     WHEN EXISTS (SELECT 1 FROM la WHERE la.food_category = s.category AND la.ir = a.intermediate_region) THEN 1
     WHEN EXISTS (SELECT 1 FROM la WHERE la.food_category = s.category AND la.sr = a.sub_region) THEN 2
     WHEN EXISTS (SELECT 1 FROM la WHERE la.food_category = s.category AND la.rg = a.region) THEN 3
     WHEN EXISTS (SELECT 1 FROM la WHERE la.food_category = s.category) THEN 4 END AS level, a.intermediate_region AS ir, a.sub_region AS sr, a.region AS rg
   FROM s2 s JOIN area a ON a.iso3 = s.supplier)
, jn AS (SELECT lv.consumer, lv.category, lv.supplier, la.obs_id, la.weight / sum(la.weight) OVER (PARTITION BY lv.consumer, lv.category, lv.supplier) * lv.share AS w
   FROM lv JOIN la ON la.food_category = lv.category AND CASE lv.level WHEN 0 THEN la.iso3 = lv.supplier WHEN 1 THEN la.ir = lv.ir WHEN 2 THEN la.sr = lv.sr WHEN 3 THEN la.rg = lv.rg WHEN 4 THEN true END)
, sm AS (SELECT consumer, category, obs_id, sum(w) AS weight FROM jn GROUP BY 1, 2, 3)
, ct AS (SELECT consumer, category, count(*) AS n FROM sm GROUP BY 1, 2)
, al AS (SELECT food_category AS category, count(*) AS n, sum(weight) AS t FROM la GROUP BY 1)
, few AS (SELECT ct.consumer, ct.category, al.t FROM ct JOIN al ON al.category = ct.category WHERE ct.n < 5 AND al.n > ct.n)
"""


def _sourcing(spark, d):
    lca = derived(spark, d, "lca")
    supply = derived(spark, d, "flow").select(F.col("importer").alias("consumer"), F.col("item").alias("category"), F.col("exporter").alias("supplier"), F.col("import_rep").alias("qty"))
    return so.reweight(supply, lca, derived(spark, d, "area"))


@query(
    "trd13_reweight",
    ctes("flow", "lca", "area") + _SOURCED + """SELECT consumer, category, obs_id, round(weight, 6) AS weight FROM sm WHERE NOT EXISTS (SELECT 1 FROM few WHERE few.consumer = sm.consumer AND few.category = sm.category)
    UNION ALL SELECT few.consumer, few.category, la.obs_id, round(la.weight / few.t * 100, 6) FROM few JOIN la ON la.food_category = few.category""",
)
def trd13(spark, d):
    return _r(_sourcing(spark, d)[0], ["consumer", "category", "obs_id"], "weight")


@query(
    "trd14_coverage",
    ctes("flow", "lca", "area") + _SOURCED + """SELECT lv.consumer, lv.category, round(sum(CASE WHEN level = 0 THEN share ELSE 0 END), 6) AS from_country, round(sum(CASE WHEN level = 1 THEN share ELSE 0 END), 6) AS from_intermediate_region,
      round(sum(CASE WHEN level = 2 THEN share ELSE 0 END), 6) AS from_sub_region, round(sum(CASE WHEN level = 3 THEN share ELSE 0 END), 6) AS from_region, round(sum(CASE WHEN level = 4 THEN share ELSE 0 END), 6) AS from_global,
      CAST(max(CASE WHEN few.t IS NOT NULL THEN 1 ELSE 0 END) AS INT) AS using_global_avg FROM lv LEFT JOIN few ON few.consumer = lv.consumer AND few.category = lv.category WHERE level IS NOT NULL GROUP BY 1, 2""",
)
def trd14(spark, d):
    log = _sourcing(spark, d)[1]
    return _r(log, ["consumer", "category", "using_global_avg"], *[f"from_{n}" for n in so.LEVELS])


@query(
    "jon11_geographic_cascade",
    ctes("flow", "lca", "area") + _SOURCED + "SELECT consumer, category, supplier, CAST(level AS INT) AS level, round(share, 6) AS share FROM lv WHERE level IS NOT NULL",
)
def jon11(spark, d):
    lca = derived(spark, d, "lca")
    supply = derived(spark, d, "flow").select(F.col("importer").alias("consumer"), F.col("item").alias("category"), F.col("exporter").alias("supplier"), F.col("import_rep").alias("qty"))
    area = derived(spark, d, "area")
    found = so.assigned_levels(so.supply_shares(supply), so._by_level(lca, area), area)
    return _r(found, ["consumer", "category", "supplier", "level"], "share")
