"""Join and set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.catalog.registry import query
from larder.fixtures import ctes, derived
from larder.operators import lists as li
from larder.operators import ordering as o
from larder.operators import relational as r
from larder.operators import trade as tr
from larder.session import scratch_path
from larder.sources import versioned


@query(
    "jon01_natural_join",
    "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
)
def jon01(spark, d):
    orders = derived(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return orders.join(derived(spark, d, "customer"), ["c_custkey"], "inner").select("o_orderkey", "c_custkey", "c_mktsegment")


@query(
    "jon02_factor_default",
    ctes("flow") + "SELECT item, yr, importer, exporter, round(import_rep * CASE item WHEN 'SMALL' THEN 0.5 WHEN 'PROMO' THEN 1.25 ELSE 1 END, 6) AS value FROM flow",
)
def jon02(spark, d):
    factors = spark.createDataFrame([("SMALL", 0.5), ("PROMO", 1.25)], "item string, factor double")
    f = r.fill_from(derived(spark, d, "flow"), factors, ["item"], "factor", 1.0)
    return f.select("item", "yr", "importer", "exporter", F.round(F.col("import_rep") * F.col("factor"), 6).alias("value"))


@query(
    "jon03_complete_dimension",
    ctes("production", "area") + """SELECT g.item, g.yr, a.iso3, round(coalesce(p.production, 0), 6) AS production
    FROM (SELECT DISTINCT item, yr FROM production) g CROSS JOIN area a LEFT JOIN production p ON p.item = g.item AND p.yr = g.yr AND p.iso3 = a.iso3""",
)
def jon03(spark, d):
    out = tr.complete_countries(derived(spark, d, "production"), derived(spark, d, "area"), ["item", "yr"], "iso3", "production")
    return out.select("item", "yr", "iso3", F.round("production", 6).alias("production"))


@query(
    "jon04_full_outer",
    ctes("ing") + """SELECT coalesce(a.id, b.id) AS id, coalesce(a.pos, b.pos) AS pos, a.p AS percent_known, b.p AS percent_embedded
    FROM (SELECT DISTINCT id, pos, percent0 AS p FROM ing WHERE percent0 IS NOT NULL) a
    FULL JOIN (SELECT DISTINCT id, pos, round(true_percent, 6) AS p FROM ing WHERE pos % 3 = 0) b ON a.id = b.id AND a.pos = b.pos""",
)
def jon04(spark, d):
    i = derived(spark, d, "ing")
    known = i.where("percent0 IS NOT NULL").select("id", "pos", F.col("percent0").alias("percent_known")).distinct()
    embedded = i.where("pos % 3 = 0").select("id", "pos", F.round("true_percent", 6).alias("percent_embedded")).distinct()
    return known.join(embedded, ["id", "pos"], "full")


@query(
    "jon05_semi_join",
    ctes("lca") + """SELECT obs_id FROM lca l WHERE EXISTS (SELECT 1 FROM lca x WHERE x.sys = 'O' AND x.food_category = l.food_category
      AND x.food_category_sub IS NOT DISTINCT FROM l.food_category_sub AND x.food_category_sub_sub IS NOT DISTINCT FROM l.food_category_sub_sub)""",
)
def jon05(spark, d):
    lca = derived(spark, d, "lca")
    return r.semi(lca, lca.where("sys = 'O'"), ["food_category", "food_category_sub", "food_category_sub_sub"]).select("obs_id")


@query("jon06_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def jon06(spark, d):
    done = derived(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return r.anti(derived(spark, d, "customer"), done, ["c_custkey"]).select("c_custkey")


@query(
    "jon07_country_grid",
    ctes("flow", "area") + """SELECT g.item, g.yr, a.iso3 AS exporter, b.iso3 AS importer, CASE WHEN a.iso3 = b.iso3 THEN 0 ELSE round(coalesce(f.import_rep, 0), 6) END AS qty
    FROM (SELECT DISTINCT item, yr FROM flow) g CROSS JOIN area a CROSS JOIN area b
    LEFT JOIN flow f ON f.item = g.item AND f.yr = g.yr AND f.exporter = a.iso3 AND f.importer = b.iso3""",
)
def jon07(spark, d):
    edges = derived(spark, d, "flow").select("item", "yr", "exporter", "importer", F.col("import_rep").alias("qty"))
    grid = tr.country_grid(edges, derived(spark, d, "area"), ["item", "yr"])
    return grid.select("item", "yr", "exporter", "importer", F.round("qty", 6).alias("qty"))


@query(
    "jon08_two_roles",
    ctes("flow", "area") + """SELECT f.item, f.yr, f.importer, f.exporter, a.country AS importer_country, a.region AS importer_region, b.country AS exporter_country, b.region AS exporter_region
    FROM flow f LEFT JOIN area a ON a.iso3 = f.importer LEFT JOIN area b ON b.iso3 = f.exporter""",
)
def jon08(spark, d):
    f = derived(spark, d, "flow").select("item", "yr", "importer", "exporter")
    return r.in_two_roles(f, derived(spark, d, "area"), "iso3", {"importer": "importer", "exporter": "exporter"}, ["country", "region"])


@query(
    "jon10_hierarchical_fallback",
    ctes("ingprod") + """, s AS (SELECT retailer, department, aisle, shelf, avg(percent0) AS v FROM ingprod GROUP BY 1, 2, 3, 4),
    a AS (SELECT retailer, department, aisle, avg(percent0) AS v FROM ingprod GROUP BY 1, 2, 3),
    e AS (SELECT retailer, department, avg(percent0) AS v FROM ingprod GROUP BY 1, 2)
    SELECT i.id, i.pos, round(coalesce(i.percent0, s.v, a.v, e.v), 9) AS percent FROM ingprod i
    LEFT JOIN s ON s.retailer = i.retailer AND s.department = i.department AND s.aisle = i.aisle AND s.shelf = i.shelf
    LEFT JOIN a ON a.retailer = i.retailer AND a.department = i.department AND a.aisle = i.aisle
    LEFT JOIN e ON e.retailer = i.retailer AND e.department = i.department""",
)
def jon10(spark, d):
    i = derived(spark, d, "ingprod").withColumn("percent", F.col("percent0"))
    levels = [["retailer", "department", "aisle", "shelf"], ["retailer", "department", "aisle"], ["retailer", "department"]]
    tables = [(i.groupBy(*k).agg(F.avg("percent0").alias("percent")), k) for k in levels]
    return r.first_filled(i, tables, "percent").select("id", "pos", F.round("percent", 9).alias("percent"))


@query(
    "jon14_known_duplicates",
    """SELECT doc_id FROM documents d WHERE doc_id % 3 <> 0 AND NOT EXISTS
       (SELECT 1 FROM documents x WHERE x.doc_id % 3 = 0 AND lower(x.text) = lower(d.text) AND lower(x.source) = lower(d.source))""",
)
def jon14(spark, d):
    t = derived(spark, d, "documents").withColumn("key_text", F.lower("text")).withColumn("key_source", F.lower("source"))
    return r.anti(t.where("doc_id % 3 <> 0"), t.where("doc_id % 3 = 0"), ["key_text", "key_source"]).select("doc_id")


@query(
    "jon15_parent_lookup",
    ctes("ing") + "SELECT i.id, i.pos, p.parent FROM ing i JOIN (SELECT p_name AS value, min(p_type) AS parent FROM part GROUP BY p_name) p ON p.value = i.value",
)
def jon15(spark, d):
    pairs = derived(spark, d, "part").groupBy(F.col("p_name").alias("value")).agg(F.min("p_type").alias("parent"))
    return derived(spark, d, "ing").join(pairs, "value").select("id", "pos", "parent")


@query(
    "jon17_role_swap",
    ctes("trade") + """SELECT item, yr, CASE WHEN element = 'Import Quantity' THEN reporter ELSE partner END AS importer,
      CASE WHEN element = 'Import Quantity' THEN partner ELSE reporter END AS exporter,
      round(sum(CASE WHEN element = 'Import Quantity' THEN value ELSE 0 END), 6) AS import_rep,
      round(sum(CASE WHEN element = 'Export Quantity' THEN value ELSE 0 END), 6) AS export_rep FROM trade GROUP BY 1, 2, 3, 4""",
)
def jon17(spark, d):
    both = tr.match_reports(derived(spark, d, "trade"))
    return both.select("item", "yr", "importer", "exporter", F.round("import_rep", 6).alias("import_rep"), F.round("export_rep", 6).alias("export_rep"))


@query(
    "set01_union_by_name",
    "SELECT p_partkey AS id, p_name AS name, NULL::DOUBLE AS balance FROM part UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer",
)
def set01(spark, d):
    p = derived(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    c = derived(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return p.unionByName(c, allowMissingColumns=True)


@query("set02_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def set02(spark, d):
    return derived(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query(
    "set03_priority_union",
    """SELECT key, label FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY src, label) AS k FROM (
       SELECT p_name AS key, p_brand AS label, 0 AS src FROM part WHERE p_size < 10 UNION ALL SELECT p_name, p_type, 1 FROM part)) WHERE k = 1""",
)
def set03(spark, d):
    p = derived(spark, d, "part")
    first = p.where("p_size < 10").select(F.col("p_name").alias("key"), F.col("p_brand").alias("label"))
    second = p.select(F.col("p_name").alias("key"), F.col("p_type").alias("label"))
    return r.union_first_wins([first, second], ["key"], [F.col("label")])


@query(
    "set04_replace_rows",
    "SELECT p_partkey, p_type FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, 'CORRECTED' FROM part WHERE p_partkey % 5 = 0",
)
def set04(spark, d):
    p = derived(spark, d, "part").select("p_partkey", "p_type")
    return r.replace_rows(p, p.where("p_partkey % 5 = 0").withColumn("p_type", F.lit("CORRECTED")), ["p_partkey"])


@query(
    "set04_upsert",
    "SELECT p_partkey, CASE WHEN p_partkey % 97 = 0 THEN 'CORRECTED' ELSE p_type END AS p_type FROM part UNION ALL SELECT max(p_partkey) + 1, 'NEW' FROM part",
)
def set04_upsert(spark, d):
    """Corrections to a stored table rewrite only the buckets that they touch."""
    path, p = scratch_path(spark, "parts"), derived(spark, d, "part").select("p_partkey", "p_type")
    versioned.create(p, path, ["p_partkey"])
    versioned.upsert(p.where("p_partkey % 97 = 0").withColumn("p_type", F.lit("CORRECTED")), path)
    versioned.upsert(p.agg((F.max("p_partkey") + 1).alias("p_partkey"), F.lit("NEW").alias("p_type")), path)
    return versioned.read_version(spark, path)


@query("set05_id_union", "SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size > 40")
def set05(spark, d):
    a = derived(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return a.union(derived(spark, d, "part").where("p_size > 40").select("p_partkey")).distinct()


@query(
    "set06_replicate_small",
    """SELECT p_partkey, p_brand, CAST(copy AS INT) AS copy FROM part JOIN (SELECT p_brand AS b, p_type AS t, count(*) AS n FROM part GROUP BY 1, 2) g
       ON g.b = p_brand AND g.t = p_type JOIN (SELECT unnest(range(0, 6)) AS copy) c ON copy = 0 OR n < 5""",
)
def set06(spark, d):
    p = r.with_totals(derived(spark, d, "part"), ["p_brand", "p_type"], n=F.count("*"))
    copies = F.when(F.col("n") < 5, F.sequence(F.lit(0), F.lit(5))).otherwise(F.array(F.lit(0)))
    return p.select("p_partkey", "p_brand", F.explode(copies).alias("copy"))


@query(
    "set07_copy_rename",
    "SELECT p_partkey, p_type FROM part UNION ALL SELECT p_partkey, 'Butter' FROM part WHERE p_type = 'SMALL' UNION ALL SELECT p_partkey, 'Oil' FROM part WHERE p_type = 'PROMO' "
    "UNION ALL SELECT p_partkey, 'Fat' FROM part WHERE p_type = 'PROMO'",
)
def set07(spark, d):
    return r.copy_rows(derived(spark, d, "part").select("p_partkey", "p_type"), "p_type", {"SMALL": ["Butter"], "PROMO": ["Oil", "Fat"]})


@query(
    "set08_combinations",
    """, """.join([
        "WITH m AS (SELECT unnest(range(1, 16384)) AS mask)",
        "t AS (SELECT n, mask, bit_count(mask) AS k FROM m, (SELECT unnest(range(2, 15)) AS n) WHERE mask < (1 << n) AND bit_count(mask) >= 2)",
        "c AS (SELECT n, k, count(*) AS combos FROM t GROUP BY n, k)",
        "z AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey)",
    ]) + " SELECT z.id, CAST(z.n AS INT) AS n, CAST(c.k AS INT) AS k, CAST(least(c.combos, 100) AS BIGINT) AS combos, CAST(least(c.combos, 100) * c.k AS BIGINT) AS hidden FROM z JOIN c ON c.n = z.n",
)
def set08(spark, d):
    lists = derived(spark, d, "ing").groupBy("id").agg(F.count("*").cast("int").alias("n"))
    combos = li.hidden_positions(spark, lists.agg(F.max("n")).first()[0] or 2).join(lists, "n")
    return combos.groupBy("id", "n", "k").agg(F.count("*").alias("combos"), F.sum(F.size("hidden")).alias("hidden"))


@query(
    "win01_keep_first",
    "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS k FROM lineitem) WHERE k = 1",
)
def win01(spark, d):
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")]
    return r.keep_first(derived(spark, d, "lineitem"), ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_linenumber")


@query("win02_keep_unrepeated", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text HAVING count(*) = 1")
def win02(spark, d):
    return r.keep_unrepeated(derived(spark, d, "documents").select("doc_id", "text"), ["text"]).select("doc_id", "text")


@query(
    "win03_prefer_filled",
    ctes("lca") + """SELECT food_category, iso3, food_category_sub, obs_id FROM (SELECT *, row_number() OVER (PARTITION BY food_category, iso3
       ORDER BY CASE WHEN food_category_sub IS NULL THEN 1 ELSE 0 END, obs_id) AS k FROM lca) WHERE k = 1""",
)
def win03(spark, d):
    out = r.prefer_filled(derived(spark, d, "lca"), ["food_category", "iso3"], "food_category_sub", [F.col("obs_id")])
    return out.select("food_category", "iso3", "food_category_sub", "obs_id")


@query("win04_last_rule", "SELECT p_partkey, p_size = max(p_size) OVER (PARTITION BY p_brand, p_type) AS last FROM part")
def win04(spark, d):
    p = r.with_totals(derived(spark, d, "part"), ["p_brand", "p_type"], top=F.max("p_size"))
    return p.select("p_partkey", (F.col("p_size") == F.col("top")).alias("last"))


@query(
    "win06_monotone_repair",
    ctes("ing") + """, x AS (SELECT id, pos, (true_percent * 7) % 10 AS v, percent0 IS NOT NULL AS keep FROM ing),
    s AS (SELECT *, sum(CASE WHEN keep THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos DESC) AS seg FROM x)
    SELECT id, pos, round(max(v) OVER (PARTITION BY id, seg ORDER BY pos DESC), 9) AS percent FROM s""",
)
def win06(spark, d):
    x = derived(spark, d, "ing").select("id", "pos", ((F.col("true_percent") * 7) % 10).alias("v"), F.col("percent0").isNotNull().alias("keep"))
    # kept values start a new segment, so they keep their own value
    return li.monotone_repair(x, ["id"], "pos", "v", "keep", "percent").select("id", "pos", F.round("percent", 9).alias("percent"))


@query(
    "win07_interpolate",
    ctes("ing") + """, k AS (SELECT id, pos, percent0 AS v FROM ing WHERE percent0 IS NOT NULL),
    b AS (SELECT i.id, i.pos, i.percent0, max(a.pos) AS pa, min(z.pos) AS pz FROM ing i LEFT JOIN k a ON a.id = i.id AND a.pos <= i.pos
          LEFT JOIN k z ON z.id = i.id AND z.pos >= i.pos GROUP BY i.id, i.pos, i.percent0)
    SELECT b.id, b.pos, round(CASE WHEN pa = pz THEN b.percent0 ELSE a.v + (z.v - a.v) / (pz - pa) * (b.pos - pa) END, 9) AS percent
    FROM b LEFT JOIN k a ON a.id = b.id AND a.pos = pa LEFT JOIN k z ON z.id = b.id AND z.pos = pz""",
)
def win07(spark, d):
    i = derived(spark, d, "ing").select("id", "pos", "percent0")
    return li.interpolate_gaps(i, ["id"], "pos", "percent0", "percent").select("id", "pos", F.round("percent", 9).alias("percent"))


@query(
    "win08_neighbour_bounds",
    ctes("ing") + """SELECT id, pos, min(percent0) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS min_before,
    max(percent0) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS max_after FROM ing""",
)
def win08(spark, d):
    return li.neighbour_bounds(derived(spark, d, "ing").select("id", "pos", "percent0"), ["id"], "pos", "percent0").select("id", "pos", "min_before", "max_after")


@query("win09_place_in_text", ctes("ing", "txt") + "SELECT id, CAST(1 + length(b) - length(replace(b, ',', '')) AS INT) AS place FROM (SELECT id, split_part(ingredients_text, 'gear', 1) AS b FROM txt WHERE contains(ingredients_text, 'gear'))")
def win09(spark, d):
    t = derived(spark, d, "txt").where(F.col("ingredients_text").contains("gear"))
    return t.select("id", li.commas_before(F.col("ingredients_text"), "gear").alias("place"))


@query(
    "win10_totals",
    ctes("ing") + "SELECT id, pos, count(*) OVER (PARTITION BY id) AS n_ingredients, round(sum(percent0) OVER (PARTITION BY id), 4) AS tot_percent FROM ing",
)
def win10(spark, d):
    # a product's own list: one window, no second pass
    w = Window.partitionBy("id")
    return derived(spark, d, "ing").select(
        "id", "pos", F.count("*").over(w).alias("n_ingredients"), F.round(F.sum("percent0").over(w), 4).alias("tot_percent")
    )


@query(
    "ord01_sort", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey",
)
def ord01(spark, d):
    return derived(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


@query(
    "ord02_argbest",
    "SELECT p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) AS cheapest, arg_max(p_partkey, (p_retailprice, p_partkey)) AS dearest FROM part GROUP BY p_brand",
)
def ord02(spark, d):
    at = F.struct("p_retailprice", "p_partkey")
    return derived(spark, d, "part").groupBy("p_brand").agg(F.min_by("p_partkey", at).alias("cheapest"), F.max_by("p_partkey", at).alias("dearest"))


@query("ord03_sample", "SELECT o_orderkey FROM orders ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def ord03(spark, d):
    return o.sample_rows(derived(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 100)


@query(
    "ord05_split",
    "SELECT part, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN CAST('0x' || substr(md5('42|' || CAST(o_orderkey AS VARCHAR)), 1, 7) AS BIGINT) / 268435456.0 < 0.8 THEN 'train' ELSE 'test' END AS part FROM orders) GROUP BY part",
)
def ord05(spark, d):
    return derived(spark, d, "orders").select(o.split_flag(["o_orderkey"]).alias("part")).groupBy("part").agg(F.count("*").alias("n"))
