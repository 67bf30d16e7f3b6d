"""Projections, filters and conditional updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.catalog.registry import query
from larder.fixtures import ctes, derived
from larder.functions import columns as c
from larder.functions import labels as lb
from larder.functions.cleaning import quality_route
from larder.functions.nutriscore import SODIUM, nutri_score
from larder.operators import ordering as o
from larder.operators import relational as r


@query("prj01_rename", "SELECT p_partkey AS product_id, p_name AS product_name, p_type AS \"Department\", p_brand AS \"Aisle\" FROM part")
def prj01(spark, d):
    names = {"p_partkey": "product_id", "p_name": "product_name", "p_type": "Department", "p_brand": "Aisle"}
    return derived(spark, d, "part").select(*names).withColumnsRenamed(names)


@query(
    "prj02_filter",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity BETWEEN 10 AND 30) AND l_returnflag IN ('A','R') "
    "AND l_shipdate IS NOT NULL AND NOT (l_linestatus = 'O' AND l_discount > 0.05)",
)
def prj02(spark, d):
    li = derived(spark, d, "lineitem")
    kept = (
        F.col("l_quantity").between(10, 30) & F.col("l_returnflag").isin("A", "R") & F.col("l_shipdate").isNotNull()
        & ~((F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.05))
    )
    return li.where(kept).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "prj03_text_filter",
    "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)the|les') AND NOT contains(lower(text), 'xx') AND NOT regexp_matches(text, 'q[^u]')",
)
def prj03(spark, d):
    t = F.col("text")
    kept = t.rlike("(?i)the|les") & ~F.lower(t).contains("xx") & ~t.rlike("q[^u]")
    return derived(spark, d, "documents").where(kept).select("doc_id")


@query(
    "prj04_quality_route",
    ctes("dirty") + """
    , t AS (SELECT id, lower(ingredients_text) || CASE id % 5 WHEN 0 THEN ' semi-dry' WHEN 1 THEN ' acid: x' ELSE '' END AS x FROM dirty)
    SELECT route, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT CASE WHEN x = '' THEN 'empty' WHEN regexp_full_match(x, '[A-Za-z0-9.(),% ]+') THEN 'plain'
        WHEN regexp_full_match(x, '[A-Za-z0-9.(),% -]+') THEN CASE WHEN contains(x, '-') AND NOT contains(x, ' - ') THEN 'hyphen' ELSE 'discard' END
        WHEN regexp_full_match(x, '[A-Za-z0-9.(),%: ]+') THEN CASE WHEN regexp_matches(x, '(preservatives?|conservatives?|acidifying|acidity|acidic|acid|colors?|colour|coloring|regulators?|corrector|emulgator|emulsifying|antioxidant|fiers?|zer|less|following|of|thickening|contains|cultures|agent):') THEN 'colon' ELSE 'discard' END
        ELSE 'discard' END AS route FROM t) GROUP BY route""",
)
def prj04(spark, d):
    t = F.concat(
        F.lower("ingredients_text"),
        F.when(F.col("id") % 5 == 0, " semi-dry").when(F.col("id") % 5 == 1, " acid: x").otherwise(""),
    )
    return derived(spark, d, "dirty").select(quality_route(t).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@query(
    "prj05_masked_update",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice FROM orders",
)
def prj05(spark, d):
    changed = F.when(F.col("o_orderstatus") == "F", F.round(F.col("o_totalprice") * 2, 2)).otherwise(F.col("o_totalprice"))
    return derived(spark, d, "orders").withColumn("o_totalprice", changed).select("o_orderkey", "o_totalprice")


@query(
    "prj06_points",
    ctes("nut") + "SELECT id, CAST(least(10, greatest(0, ceil(sodium / 90.0) - 1)) AS INT) AS sodium_points, "
    "CASE WHEN fvno > 80 THEN 5 WHEN fvno > 60 THEN 2 WHEN fvno > 40 THEN 1 ELSE 0 END AS fvno_points FROM nut",
)
def prj06(spark, d):
    return derived(spark, d, "nut").select(
        "id", c.points_above(F.col("sodium"), SODIUM).alias("sodium_points"),
        c.points_above(F.col("fvno"), [40, 60, 80], [1, 2, 5]).alias("fvno_points"),
    )


@query("prj07_fill_ladder", ctes("ing") + "SELECT id, pos, round(CASE WHEN percent0 IS NOT NULL THEN percent0 WHEN pos = 1 THEN true_percent ELSE 0 END, 6) AS percent FROM ing")
def prj07(spark, d):
    ladder = F.coalesce("percent0", F.when(F.col("pos") == 1, F.col("true_percent")), F.lit(0.0))
    return derived(spark, d, "ing").select("id", "pos", F.round(ladder, 6).alias("percent"))


@query("prj08_longer_text", "SELECT p_partkey, CASE WHEN length(p_brand) > length(p_name) THEN p_brand ELSE p_name END AS name FROM part")
def prj08(spark, d):
    return derived(spark, d, "part").select("p_partkey", c.longer_text(F.col("p_name"), F.col("p_brand")).alias("name"))


_COUNTRY = ("Russian Federation", "Viet Nam", "France", "Italy", "Norway", "Poland", "Greece", "India", "Japan", "Canada")
_COUNTRY_SQL = "CASE n_nationkey % 10 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_COUNTRY)) + " END"


@query(
    "prj09_harmonise",
    f"SELECT n_nationkey, CASE {_COUNTRY_SQL} WHEN 'Russian Federation' THEN 'Russia' WHEN 'Viet Nam' THEN 'Vietnam' ELSE {_COUNTRY_SQL} END AS country FROM nation",
)
def prj09(spark, d):
    n = derived(spark, d, "nation").withColumn("country", F.expr(_COUNTRY_SQL))
    return n.select("n_nationkey", c.renamed(F.col("country"), c.COUNTRY_NAMES).alias("country"))


@query(
    "prj10_country_group",
    f"SELECT c_custkey, CASE {_COUNTRY_SQL.replace('n_nationkey', 'c_nationkey')} WHEN 'France' THEN 'EUwest' WHEN 'Italy' THEN 'EUsouth' WHEN 'Norway' THEN 'Nordic' "
    "WHEN 'Poland' THEN 'EUeast' WHEN 'Greece' THEN 'MedAf' WHEN 'India' THEN 'LatAmMeSAsia' WHEN 'Japan' THEN 'EAsia' ELSE 'UK' END AS country_group FROM customer",
)
def prj10(spark, d):
    country = F.expr(_COUNTRY_SQL.replace("n_nationkey", "c_nationkey"))
    return derived(spark, d, "customer").select("c_custkey", c.country_group(country).alias("country_group"))


@query(
    "prj11_surrogate_id",
    "SELECT CAST('29112024' || CAST(row_number() OVER (ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS VARCHAR) AS BIGINT) AS product_id, o_orderkey FROM orders",
)
def prj11(spark, d):
    return o.surrogate_id(derived(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "29112024").select("product_id", "o_orderkey")


@query(
    "prj12_store",
    ctes("web") + """, u AS (SELECT product_id, CASE WHEN contains(energy_per_100, 'http') THEN energy_per_100
       WHEN contains(product_name, 'http') THEN product_name WHEN contains(url, 'http') THEN url ELSE 'null' END AS u FROM web)
    SELECT product_id, CASE WHEN contains(u, 'tesco.ie') THEN 'tesco ireland' WHEN contains(u, 'tesco') THEN 'tesco'
      WHEN contains(u, 'waitrose') THEN 'waitrose' WHEN contains(u, 'morrisons') THEN 'morrisons' WHEN contains(u, 'sainsbury') THEN 'sainsbury'
      WHEN contains(u, 'cook') THEN 'cook' WHEN contains(u, 'aldi') THEN 'aldi' WHEN contains(u, 'iceland') THEN 'iceland'
      WHEN contains(u, 'ocado') THEN 'ocado' ELSE u END AS store FROM u""",
)
def prj12(spark, d):
    w = derived(spark, d, "web")
    return w.select("product_id", c.store_of(F.col("url"), F.col("product_name"), F.col("energy_per_100")).alias("store"))


_TOKEN = "CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN 'NaN' WHEN 3 THEN 'na' WHEN 4 THEN NULL ELSE o_orderstatus END"


@query("prj13_null_tokens", f"SELECT o_orderkey, CASE WHEN o_orderkey % 8 >= 5 THEN o_orderstatus END AS status FROM orders")
def prj13(spark, d):
    return derived(spark, d, "orders").select("o_orderkey", c.no_null_tokens(F.expr(_TOKEN)).alias("status"))


@query("prj14_area_code", ctes("trade") + "SELECT item, yr, element, CAST(substr(reporter, 2) AS INT) AS reporter, CAST(substr(partner, 2) AS INT) AS partner FROM trade")
def prj14(spark, d):
    t = derived(spark, d, "trade")
    return t.select("item", "yr", "element", c.area_code(F.col("reporter")).alias("reporter"), c.area_code(F.col("partner")).alias("partner"))


@query("prj15_percent_strip", "SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size AS DOUBLE) END AS weight FROM part")
def prj15(spark, d):
    text = F.when(F.col("p_partkey") % 9 == 0, "-").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("%")))
    return derived(spark, d, "part").select("p_partkey", c.percent_number(text).alias("weight"))


@query("prj16_sense_check", ctes("ing") + "SELECT id, pos, CASE WHEN percent0 * 2 <= 100.0 / pos THEN percent0 * 2 END AS percent FROM ing")
def prj16(spark, d):
    return derived(spark, d, "ing").select("id", "pos", c.plausible_percent(F.col("percent0") * 2, F.col("pos")).alias("percent"))


@query(
    "prj17_parentheses",
    ctes("dirty") + "SELECT id, CASE WHEN length(ingredients_text) - length(replace(ingredients_text, '(', '')) = "
    "length(ingredients_text) - length(replace(ingredients_text, ')', '')) THEN 'Equal' ELSE 'Unequal' END AS parentheses FROM dirty",
)
def prj17(spark, d):
    return derived(spark, d, "dirty").select("id", c.equal_parentheses(F.col("ingredients_text")).alias("parentheses"))


@query("prj18_leaf_levels", "SELECT p_partkey, p_type AS level0, CASE WHEN p_type IN ('SMALL', 'PROMO') THEN p_type ELSE p_brand END AS level1 FROM part")
def prj18(spark, d):
    p = derived(spark, d, "part")
    return p.select("p_partkey", F.col("p_type").alias("level0"), c.leaf_or(F.col("p_brand"), F.col("p_type"), ["SMALL", "PROMO"]).alias("level1"))


@query(
    "prj19_drop_products",
    ctes("ing") + "SELECT id, pos, round(true_percent, 6) AS true_percent FROM ing WHERE id NOT IN (SELECT id FROM ing WHERE true_percent < 2)",
)
def prj19(spark, d):
    kept = r.drop_products_with(derived(spark, d, "ing"), ["id"], F.col("true_percent") < 2)
    return kept.select("id", "pos", F.round("true_percent", 6).alias("true_percent"))


_NUT_SQL = """
, x AS (SELECT id, {col} AS t, regexp_extract({col}, '(\\d{{1,4}}\\s*[.,]?\\s*\\d{{0,3}})', 1) AS num,
        lower(regexp_extract({col}, '(?i)(mg|g|kcal|calorie|kj|j|kiloj)', 1)) AS u FROM labelled)
, y AS (SELECT id, CASE WHEN regexp_full_match(trim(t), '\\d+([.,]\\d+)?') THEN '{dflt}' ELSE u END AS u,
        TRY_CAST(replace(regexp_replace(num, '\\s+', '', 'g'), ',', '.') AS DOUBLE) AS v FROM x)
"""


@query(
    "txt20_nutrient",
    ctes("labelled") + _NUT_SQL.format(col="energy_per_100", dflt="kj") + """
    , e AS (SELECT id, CASE u WHEN 'kj' THEN v WHEN 'kcal' THEN v * 4.184 END AS energy FROM y)
    """ + _NUT_SQL.format(col="salt_per_100", dflt="g").replace(", x AS", ", x2 AS").replace("FROM x)", "FROM x2)").replace(", y AS", ", y2 AS") + """
    , s AS (SELECT id, CASE u WHEN 'g' THEN v WHEN 'mg' THEN v / 1000 END AS salt FROM y2)
    SELECT e.id, round(energy, 6) AS energy_value, CASE WHEN energy IS NOT NULL THEN 'kj' END AS energy_unit,
           round(salt, 6) AS salt_value, CASE WHEN salt IS NOT NULL THEN 'g' END AS salt_unit FROM e JOIN s ON s.id = e.id""",
)
def txt20(spark, d):
    df = derived(spark, d, "labelled").select(
        "id", lb.nutrient(F.col("energy_per_100"), energy=True).alias("e"), lb.nutrient(F.col("salt_per_100")).alias("s")
    )
    return df.select(
        "id", F.round("e.value", 6).alias("energy_value"), F.col("e.unit").alias("energy_unit"),
        F.round("s.value", 6).alias("salt_value"), F.col("s.unit").alias("salt_unit"),
    )


@query(
    "txt21_serving",
    ctes("labelled") + r"""
    , p AS (SELECT id, serving_text AS t, CASE id % 5 WHEN 0 THEN (id % 9 + 1.0) * (id % 90 + 10) WHEN 1 THEN 1000.0 WHEN 2 THEN id % 700 + 1.0 WHEN 3 THEN 1500.0 END AS pack FROM labelled)
    , v AS (SELECT id, pack, CASE id % 11 WHEN 0 THEN pack / (id % 8 + 1) WHEN 1 THEN id % 400 + 1.0 WHEN 2 THEN id % 400 + 1.0 WHEN 3 THEN id % 40 + 0.5
        WHEN 4 THEN id % 300 + 1.0 WHEN 5 THEN 75.0 WHEN 6 THEN id % 60 + 1.0 + id % 50 WHEN 7 THEN id % 60 + 1.0 WHEN 8 THEN 200.0 END AS v,
        CASE WHEN id % 11 IN (2, 8) THEN 'ml' WHEN id % 11 BETWEEN 1 AND 8 THEN 'g' END AS u FROM p)
    SELECT id, CASE WHEN v < 1000 AND NOT coalesce(v > pack, false) THEN round(CAST(v AS DOUBLE), 6) END AS serving_value,
           CASE WHEN v < 1000 AND NOT coalesce(v > pack, false) THEN u END AS serving_unit, CAST(pack AS DOUBLE) AS pack_size FROM v""",
)
def txt21(spark, d):
    df = derived(spark, d, "labelled").select("id", lb.serving(F.col("serving_text"), F.col("product_name")).alias("s"))
    return df.select("id", F.round("s.value", 6).alias("serving_value"), F.col("s.unit").alias("serving_unit"), F.col("s.pack").alias("pack_size"))


@query(
    "txt22_serving_unit",
    ctes("labelled") + "SELECT id, CASE WHEN serving_text IS NOT NULL AND serving_text <> '' AND NOT contains(serving_text, 'g') THEN 'ml' ELSE 'g' END AS unit FROM labelled",
)
def txt22(spark, d):
    return derived(spark, d, "labelled").select("id", lb.serving_unit(F.col("serving_text")).alias("unit"))




def _case(x, cuts, points=None):
    points = points or list(range(1, len(cuts) + 1))
    return "CASE " + " ".join(f"WHEN {x} > {k} THEN {p}" for k, p in sorted(zip(cuts, points), reverse=True)) + " ELSE 0 END"


_RATIO = "CASE WHEN fat = 0 THEN NULL ELSE saturated_fat / fat END"
_SCORE = ctes("nut") + f"""
, p AS (SELECT *, CASE WHEN drinks = 'Drinks' THEN {_case('calories * 4.184', [0,30,60,90,120,150,180,210,240,270])}
      ELSE {_case('calories * 4.184', [335,670,1005,1340,1675,2010,2345,2680,3015,3350])} END AS e,
    CASE WHEN drinks = 'Drinks' THEN {_case('sugar', [0,1.5,3,4.5,6,7.5,9,10.5,12,13.5])} ELSE {_case('sugar', [4.5,9,13.5,18,22.5,27,31,36,40,45])} END AS s,
    {_case('saturated_fat', list(range(1, 11)))} AS f, {_case('sodium', list(range(90, 901, 90)))} AS n,
    CASE WHEN {_RATIO} IS NULL THEN NULL {' '.join(f'WHEN {_RATIO} < {k} THEN {i}' for i, k in enumerate([.1,.16,.22,.28,.34,.4,.46,.52,.58,.64]))} ELSE 10 END AS fr,
    CASE WHEN drinks = 'Drinks' THEN {_case('fvno', [40,60,80], [2,4,10])} ELSE {_case('fvno', [40,60,80], [1,2,5])} END AS v,
    CASE WHEN drinks = 'Drinks' THEN {_case('fiber', [.9,1.9,2.8,3.7,4.7])} ELSE {_case('fiber', [.7,1.4,2.1,2.8,3.5])} END AS b,
    {_case('protein', [1.6,3.2,4.8,6.4,8])} AS r FROM nut)
, q AS (SELECT *, e+s+f+n AS neg, CASE WHEN drinks <> 'Drinks' AND fat_oil = 'Fats.Oils' THEN e+s+fr+n-b-r
      WHEN drinks <> 'Drinks' AND cheese = 'Cheese' THEN e+s+f+n-b-v-r WHEN e+s+f+n >= 11 AND v < 5 THEN e+s+f+n-b-v ELSE e+s+f+n-b-v-r END AS pts FROM p)
"""


@query(
    "nut06_letters",
    _SCORE + """SELECT id, CAST(neg AS INT) AS negative_points, CAST(pts AS INT) AS score_points,
     CASE WHEN drinks = 'Drinks' THEN CASE WHEN lower(product_name) LIKE '%water%' THEN 'A' WHEN pts <= 1 THEN 'B' WHEN pts <= 5 THEN 'C' WHEN pts <= 9 THEN 'D' WHEN pts >= 10 THEN 'E' END
          ELSE CASE WHEN pts <= -1 THEN 'A' WHEN pts <= 2 THEN 'B' WHEN pts <= 10 THEN 'C' WHEN pts <= 18 THEN 'D' WHEN pts >= 19 THEN 'E' END END AS score_letter,
     round((pts + 15) / 55.0, 6) AS score_scaled FROM q""",
)
def nut06_letters(spark, d):
    return nutri_score(derived(spark, d, "nut")).select(
        "id", "negative_points", "score_points", "score_letter", F.round("score_scaled", 6).alias("score_scaled")
    )
