"""Food-shaped tables derived from the star schema, as SQL that Spark and DuckDB both run.

Real deployments read product, trade and life-cycle tables; here the same shapes are derived
from the given tables so that every operator works on data that grows with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from larder.sources.tables import SCHEMAS, table

_SQL: dict[str, str] = {}

# One row per ingredient: the order is the product, lines ranked by quantity are its ingredients.
_SQL["ing"] = """
SELECT l.id, CAST(l.pos AS INT) AS pos, p_name AS value, p_type AS food_category, p_brand AS food_category_sub,
       CASE WHEN p_partkey % 3 = 0 THEN p_name END AS food_category_sub_sub,
       100.0 * l_quantity / tot AS true_percent,
       CASE WHEN l_returnflag = 'A' THEN round(CAST(100.0 * l_quantity / tot AS DOUBLE), 2) END AS percent0
FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY id) AS tot
      FROM (SELECT l_orderkey AS id, l_partkey, l_quantity, l_returnflag,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey,
                                      l_suppkey, l_extendedprice) AS pos
            FROM {lineitem}) ranked) l
JOIN {part} ON p_partkey = l_partkey
"""

# Ingredient text with nested lists and printed percents.
_SQL["txt"] = """
SELECT id, {listagg} AS ingredients_text
FROM (SELECT id, pos,
             value || CASE WHEN pos % 3 = 0 THEN ' (' || lower(food_category) || ', '
                           || lower(replace(food_category_sub, '#', ' ')) || ')' ELSE '' END
             || CASE WHEN percent0 IS NOT NULL THEN ' (' || CAST(CAST(percent0 AS DECIMAL(5,2)) AS STRING) || '%)'
                     ELSE '' END AS piece
      FROM {ing}) pieces
GROUP BY id
"""

# The same text as a shop would print it: boilerplate, brackets, accents, odd separators.
_SQL["dirty"] = """
SELECT id,
       CASE id % 4 WHEN 0 THEN 'INGREDIENTS: ' WHEN 1 THEN 'Ingredients list: Crème_fraîche, ' WHEN 2 THEN 'Œuf* & ' ELSE '' END
       || CASE id % 3 WHEN 0 THEN replace(replace(ingredients_text, '(', '['), ')', ']')
                      WHEN 1 THEN replace(ingredients_text, ', ', '; ')
                      ELSE replace(replace(ingredients_text, '%)', ' per cent)'), 'widget', '(12% widget') END
       || CASE id % 7 WHEN 0 THEN '. May contain nuts and milk.' WHEN 1 THEN ', sugar 5%. Allergy advice: see bold'
                      WHEN 2 THEN ', salt () †from Organic farming' WHEN 3 THEN '. It can contain traces of egg'
                      WHEN 4 THEN ', contains less than of the following: gum. Possible traces of nuts'
                      WHEN 5 THEN ', origin France, beef from organic farming' ELSE '' END AS ingredients_text
FROM {txt}
"""

# Products with the store hierarchy.
_SQL["prod"] = """
SELECT o_orderkey AS id, concat('product ', CAST(o_orderkey AS STRING)) AS product_name, r_name AS retailer,
       n_name AS country, o_orderpriority AS department, c_mktsegment AS aisle, o_orderstatus AS shelf
FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey
JOIN {region} ON r_regionkey = n_regionkey
"""

# Ingredients with their product's place in the store.
_SQL["ingprod"] = """
SELECT i.id, i.pos, i.value, i.food_category, i.food_category_sub, i.food_category_sub_sub, i.true_percent, i.percent0,
       p.product_name, p.retailer, p.country, p.department, p.aisle, p.shelf
FROM {ing} i JOIN {prod} p ON p.id = i.id
"""

# Bilateral trade reports.
_SQL["flow"] = """
SELECT p_type AS item, CAST(year(o_orderdate) AS INT) AS yr, c_nationkey AS importer, s_nationkey AS exporter,
       sum(l_quantity) AS import_rep,
       sum(CASE WHEN l_linenumber = 7 THEN 0.5 WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 0.0 ELSE 1.0 END
           * l_quantity) AS export_rep
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey
JOIN {supplier} ON s_suppkey = l_suppkey JOIN {part} ON p_partkey = l_partkey
GROUP BY p_type, year(o_orderdate), c_nationkey, s_nationkey
"""

# Reported trade in long form: one row per reporter, partner and element, with text country codes.
_SQL["trade"] = """
SELECT item, yr, 'Import Quantity' AS element, 't' AS unit, '''' || lpad(CAST(importer AS STRING), 3, '0') AS reporter,
       '''' || lpad(CAST(exporter AS STRING), 3, '0') AS partner, import_rep AS value FROM {flow}
UNION ALL
SELECT item, yr, 'Export Quantity', 't', '''' || lpad(CAST(exporter AS STRING), 3, '0'),
       '''' || lpad(CAST(importer AS STRING), 3, '0'), export_rep FROM {flow}
"""

# Production per item, year and country.
_SQL["production"] = """
SELECT p_type AS item, CAST(year(o_orderdate) AS INT) AS yr, s_nationkey AS iso3,
       sum(l_quantity * CASE WHEN s_nationkey % 5 = 0 THEN 0.0 WHEN s_nationkey % 2 = 1 THEN 0.5 ELSE 1.0 END) AS production
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {supplier} ON s_suppkey = l_suppkey
JOIN {part} ON p_partkey = l_partkey
GROUP BY p_type, year(o_orderdate), s_nationkey
"""

# Supply and use in long form: elements in one column, a text area code.
_SQL["supply_use"] = """
SELECT '''' || lpad(CAST(s_nationkey AS STRING), 3, '0') AS area_code, p_brand AS item, CAST(year(o_orderdate) AS INT) AS yr,
       CASE l_linenumber % 4 WHEN 0 THEN 'Food' WHEN 1 THEN 'Feed' WHEN 2 THEN 'Processed' ELSE 'Loss' END AS element,
       sum(l_quantity) AS value
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {supplier} ON s_suppkey = l_suppkey
JOIN {part} ON p_partkey = l_partkey
GROUP BY 1, 2, 3, 4
"""

# Area codes and nested region groups; some intermediate regions are missing.
_SQL["area"] = """
SELECT n_nationkey AS iso3, n_name AS country, n_regionkey AS region, n_regionkey * 10 + n_nationkey % 2 AS sub_region,
       CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey * 10 + n_nationkey % 2 END AS intermediate_region
FROM {nation}
"""

# Life-cycle observations.
_SQL["lca"] = """
SELECT p_partkey AS obs_id, p_type AS food_category, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS food_category_sub,
       CASE WHEN p_partkey % 4 = 1 THEN p_name END AS food_category_sub_sub,
       CAST(p_partkey % 25 AS INT) AS iso3, CAST(p_size AS DOUBLE) AS weight, p_retailprice / 100.0 AS ghg,
       CAST(p_partkey % 97 + 1 AS DOUBLE) AS land, CAST(p_partkey % 53 + 1 AS DOUBLE) AS eut,
       CAST(p_partkey % 31 * 10 + 1 AS DOUBLE) AS watscar, CAST(p_partkey % 13 + 1 AS DOUBLE) AS biodiversity,
       CAST(p_partkey % 17 + 1 AS DOUBLE) AS acidification, CAST(p_partkey % 19 + 1 AS DOUBLE) AS wateruse,
       CASE WHEN p_partkey % 7 = 0 THEN 'O' ELSE 'C' END AS sys
FROM {part}
"""

# Nutrition per 100 g that crosses every score threshold.
_SQL["nut"] = """
SELECT p_partkey AS id, p_name AS product_name, CAST((p_partkey * 37) % 900 AS DOUBLE) AS calories,
       CAST((p_partkey * 11) % 500 AS DOUBLE) / 10 AS sugar, CAST((p_partkey * 7) % 120 AS DOUBLE) / 10 AS saturated_fat,
       CAST((p_partkey * 7) % 120 AS DOUBLE) / 10 + (p_partkey % 30) AS fat, CAST((p_partkey * 13) % 1000 AS DOUBLE) AS sodium,
       CAST((p_partkey * 3) % 60 AS DOUBLE) / 10 AS fiber, CAST((p_partkey * 17) % 100 AS DOUBLE) / 10 AS protein,
       CAST((p_partkey * 19) % 101 AS DOUBLE) AS fvno,
       CASE WHEN p_type = 'ECONOMY' THEN 'Drinks' ELSE 'No' END AS drinks,
       CASE WHEN p_type = 'PROMO' THEN 'Cheese' ELSE 'No' END AS cheese,
       CASE WHEN p_type = 'SMALL' THEN 'Fats.Oils' ELSE 'No' END AS fat_oil
FROM {part}
"""

# Label strings for the nutrient and serving parsers.
_SQL["labelled"] = """
SELECT p_partkey AS id,
       CASE p_partkey % 7 WHEN 0 THEN CAST(p_partkey % 900 AS STRING) || ' kcal' WHEN 1 THEN CAST(p_partkey % 900 AS STRING) || 'kJ'
            WHEN 2 THEN CAST(p_partkey % 900 AS STRING) WHEN 3 THEN 'n/a' WHEN 4 THEN CAST(p_partkey % 90 AS STRING) || ',' || CAST(p_partkey % 10 AS STRING) || ' KCAL'
            WHEN 5 THEN CAST(p_partkey % 90 AS STRING) || ' g' END AS energy_per_100,
       CASE p_partkey % 6 WHEN 0 THEN CAST(p_partkey % 900 AS STRING) || ',' || CAST(p_partkey % 10 AS STRING) || ' mg'
            WHEN 1 THEN CAST(p_partkey % 90 AS STRING) || '.' || CAST(p_partkey % 10 AS STRING) || 'g' WHEN 2 THEN CAST(p_partkey % 90 AS STRING) || ',5'
            WHEN 3 THEN '<0.' || CAST(p_partkey % 10 AS STRING) || ' G' WHEN 4 THEN 'trace' END AS salt_per_100,
       CASE p_partkey % 11 WHEN 0 THEN '1/' || CAST(p_partkey % 8 + 1 AS STRING) || ' of pack'
            WHEN 1 THEN CAST(p_partkey % 400 + 1 AS STRING) || 'g' WHEN 2 THEN CAST(p_partkey % 400 + 1 AS STRING) || ' ml glass'
            WHEN 3 THEN CAST(p_partkey % 40 AS STRING) || '.5 g' WHEN 4 THEN '1/2 pack (' || CAST(p_partkey % 300 + 1 AS STRING) || 'g)'
            WHEN 5 THEN '75g dry 180g cooked' WHEN 6 THEN CAST(p_partkey % 60 + 1 AS STRING) || 'g no sauce ' || CAST(p_partkey % 50 AS STRING) || 'g to serve'
            WHEN 7 THEN CAST(p_partkey % 60 + 1 AS STRING) || 'g = 1 biscuit, 2 = ' || CAST(p_partkey % 50 AS STRING) || 'g'
            WHEN 8 THEN '200ml or 250ml' WHEN 9 THEN '1 portion' END AS serving_text,
       p_name || CASE p_partkey % 5 WHEN 0 THEN ' ' || CAST(p_partkey % 9 + 1 AS STRING) || 'x' || CAST(p_partkey % 90 + 10 AS STRING) || 'g'
            WHEN 1 THEN ' 1kg' WHEN 2 THEN ' ' || CAST(p_partkey % 700 + 1 AS STRING) || ' ml' WHEN 3 THEN ' 1.5kg' ELSE '' END AS product_name
FROM {part}
"""

# Web-like product columns for store extraction.
_SQL["web"] = """
SELECT page_id AS product_id, url, CASE WHEN page_id % 5 = 0 THEN 'http://www.tesco.' || CASE WHEN page_id % 2 = 0 THEN 'ie' ELSE 'com' END || '/p' ELSE 'name' END AS product_name,
       CASE WHEN page_id % 7 = 0 THEN 'https://www.waitrose.com/x' WHEN page_id % 11 = 0 THEN 'http://aldi.co.uk' END AS energy_per_100
FROM {pages}
"""

_LISTAGG = {
    "spark": "listagg(piece, ', ') WITHIN GROUP (ORDER BY pos)",
    "duckdb": "string_agg(piece, ', ' ORDER BY pos)",
}
_NAMES = re.compile(r"\{(\w+)\}")


def _expand(name: str, dialect: str) -> str:
    def fill(match: re.Match) -> str:
        inner = match.group(1)
        if inner == "listagg":
            return _LISTAGG[dialect]
        if inner in _SQL:
            return f"({_expand(inner, dialect)})"
        return f"{{{inner}}}" if dialect == "spark" else inner

    return _NAMES.sub(fill, _SQL[name]).strip()


#: Lines of one task where they are put together to lists.  Their number of tasks follows their number, so a task's memory doesn't.
LINES_A_TASK = 150_000


def dealt(lines: DataFrame, part: DataFrame, lines_a_task: int) -> dict[str, DataFrame]:
    """Lines by their order and parts by their key, in as many tasks as the lines take; the same rows."""
    tasks = -(-lines.count() // lines_a_task)
    if tasks <= 8:  # few rows are left to Spark
        return {"lineitem": lines, "part": part}
    return {"lineitem": lines.repartition(tasks, "l_orderkey"), "part": part.repartition(tasks, "p_partkey")}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a lazy DataFrame (or a given table, when ``name`` is one)."""
    if name in SCHEMAS:
        return table(spark, sf_dir, name)
    sql = _expand(name, "spark")
    tables = {t: table(spark, sf_dir, t) for t in sorted(set(_NAMES.findall(sql)))}
    if _expand("ing", "spark") in sql:
        tables |= dealt(tables["lineitem"], tables["part"], LINES_A_TASK)
    return spark.sql(sql, **tables)


def ctes(*names: str) -> str:
    """``WITH`` clause that defines the named derived tables for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({_expand(n, 'duckdb')})" for n in names) + "\n"
