"""Impact, Monte-Carlo, nutrition and health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.catalog.registry import query, rounded, rounded_sql
from larder.fixtures import ctes, derived
from larder.functions.draws import MODULUS, draw_sql, key_number_sql, normal_sql, uniform_sql
from larder.operators import health as he
from larder.operators import impacts as im
from larder.operators import lca as lc
from larder.operators import montecarlo as mc
from larder.operators import simulation as sm
from larder.operators import summaries as su

PRODUCT = ["id", "product_name", "retailer", "country", "department", "aisle", "shelf"]


def _r(df, keys, *cols, digits=6):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in cols])


_MEAN_LCA = "SELECT food_category, avg(ghg) AS ghg, avg(land) AS land, avg(eut) AS eut, avg(watscar) AS watscar FROM lca GROUP BY 1"


def _mean_lca(spark, d):
    return derived(spark, d, "lca").groupBy("food_category").agg(*[F.avg(i).alias(i) for i in ("ghg", "land", "eut", "watscar")])


@query(
    "env01_impacts",
    ctes("ing", "lca") + f", m AS ({_MEAN_LCA}) SELECT id, round(coalesce(sum(ghg / 10 * true_percent / 100), 0), 6) AS ghg_100g, round(coalesce(sum(land / 10 * true_percent / 100), 0), 6) AS land_100g FROM ing LEFT JOIN m ON m.food_category = ing.food_category GROUP BY 1",
)
def env01(spark, d):
    i = derived(spark, d, "ing").withColumn("percent", F.col("true_percent"))
    return _r(im.impacts_per_100g(i, _mean_lca(spark, d), ["id"], ["ghg", "land"]), ["id"], "ghg_100g", "land_100g")


RATIOS = [("Flakes", "SMALL", 0.8), ("Brand#2 Cheese", "PROMO", 0.5), ("Semi-hard Cheese", "LARGE", 0.25)]


def _cheesy(df):
    sub = F.when(F.col("food_category") == "PROMO", F.concat("food_category_sub", F.lit(" Cheese"))).when(F.col("food_category_sub") == "Brand#3", "Medium Cheese").otherwise(F.col("food_category_sub"))
    return df.withColumn("food_category_sub", sub)


@query(
    "env02_converted",
    ctes("lca") + """SELECT obs_id, CASE food_category WHEN 'SMALL' THEN 'Flakes' WHEN 'PROMO' THEN 'Brand#2 Cheese' ELSE 'Semi-hard Cheese' END AS food_category, round(ghg / CASE food_category WHEN 'SMALL' THEN 0.8 WHEN 'PROMO' THEN 0.5 ELSE 0.25 END, 6) AS ghg,
      round(land / CASE food_category WHEN 'SMALL' THEN 0.8 WHEN 'PROMO' THEN 0.5 ELSE 0.25 END, 6) AS land FROM lca WHERE food_category = 'SMALL' OR (food_category = 'PROMO' AND food_category_sub = 'Brand#2') OR (food_category = 'LARGE' AND food_category_sub = 'Brand#3')""",
)
def env02(spark, d):
    ratios = spark.createDataFrame([(a, b, *[r] * 7) for a, b, r in RATIOS], ["derived", "original", *lc.INDICATORS])
    return _r(lc.converted(_cheesy(derived(spark, d, "lca")), ratios), ["obs_id", "food_category"], "ghg", "land")


def _capture(spark, d):
    fish = derived(spark, d, "supplier").select(
        F.col("s_suppkey").alias("fish_id"), F.element_at(F.array(*[F.lit(x) for x in ("Shrimps", "Cods", "Lobsters")]), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("fish"),
        (F.col("s_nationkey") + 1.0).alias("median"), (F.col("s_nationkey") * 0.5).alias("lower_95"), (F.col("s_nationkey") * 2 + 3.0).alias("upper_95"),
    )
    return lc.capture_draws(fish)


_FISH = f""", f AS (SELECT s_suppkey AS fish_id, CASE s_suppkey % 3 WHEN 0 THEN 'Shrimps' WHEN 1 THEN 'Cods' ELSE 'Lobsters' END AS fish, s_nationkey + 1.0::DOUBLE AS median, s_nationkey * 0.5::DOUBLE AS lower_95, s_nationkey * 2 + 3.0::DOUBLE AS upper_95 FROM supplier)
, d AS (SELECT fish_id, fish, CAST(draw AS INT) AS draw, median + ((upper_95 - median) + (median - lower_95)) / 2 / 1.96::DOUBLE * {normal_sql(['fish_id', 'draw'])} AS impact FROM f, (SELECT unnest(range(1, 101)) AS draw))"""


@query("ord06_normal_draws", "WITH x AS (SELECT 1)" + _FISH + " SELECT fish_id, draw, round(impact, 6) AS impact FROM d WHERE impact > 0")
def ord06(spark, d):
    return _r(_capture(spark, d), ["fish_id", "draw"], "impact")


@query(
    "env04_capture",
    "WITH x AS (SELECT 1)" + _FISH + """, e AS (SELECT * FROM d WHERE impact > 0 UNION ALL SELECT fish_id, 'Prawns', draw, impact FROM d WHERE impact > 0 AND fish = 'Shrimps')
    SELECT fish, CASE WHEN fish = 'Cods' THEN 'Fish (capture)' ELSE 'Crustaceans (capture)' END AS food_category, CASE fish WHEN 'Shrimps' THEN 'Shrimp' WHEN 'Prawns' THEN 'Prawn' WHEN 'Cods' THEN 'Cod' END AS food_category_sub,
      CASE fish WHEN 'Cods' THEN 3.0 WHEN 'Shrimps' THEN 2.0 ELSE 7.0 END::DOUBLE AS weight, draw, round(impact / 1000, 9) AS ghg FROM e""",
)
def env04(spark, d):
    matches = spark.createDataFrame([("Cods", "Cod")], "fish string, sub string")
    weights = spark.createDataFrame([("Cods", "Fish (capture)", 3.0), ("Shrimps", "Crustaceans (capture)", 2.0), ("", "Crustaceans (capture)", 7.0)], "fish string, food_category string, weight double")
    return lc.capture_observations(_capture(spark, d), matches, weights).withColumn("ghg", F.round("ghg", 9))


@query(
    "env03_assembled",
    ctes("lca") + """, s AS (SELECT *, CASE WHEN food_category = 'PROMO' THEN food_category_sub || ' Cheese' ELSE food_category_sub END AS sub FROM lca)
    , z AS (SELECT food_category AS c, sub, weight, ghg FROM s UNION ALL SELECT 'Flakes', sub, weight, ghg / 0.8 FROM s WHERE food_category = 'SMALL' UNION ALL SELECT 'Butter, Cream & Ghee', sub, weight, ghg FROM s WHERE food_category = 'MEDIUM'
      UNION ALL SELECT 'Salt', NULL, 1.0, 0.0 UNION ALL SELECT 'Water', NULL, 1.0, 0.0)
    SELECT CASE WHEN c = 'MEDIUM' THEN 'Milk' ELSE c END AS food_category, count(*) AS n, count(sub) AS n_sub, round(sum(weight), 6) AS weight, """ + rounded_sql("sum(ghg)", 4) + " AS ghg FROM z GROUP BY 1",
)
def env03(spark, d):
    obs = derived(spark, d, "lca")
    sub = F.when(F.col("food_category") == "PROMO", F.concat("food_category_sub", F.lit(" Cheese"))).otherwise(F.col("food_category_sub"))
    obs = obs.withColumn("sub", sub).withColumn("food_category", F.when(F.col("food_category") == "MEDIUM", "Milk").otherwise(F.col("food_category")))
    details = obs.withColumn("product_details", F.col("obs_id").cast("string")).drop("food_category_sub", "food_category_sub_sub", "sub")
    subs = obs.select("food_category", F.col("obs_id").cast("string").alias("product_details"), F.col("sub").alias("food_category_sub"), F.lit(None).cast("string").alias("food_category_sub_sub"))
    ratios = spark.createDataFrame([("Flakes", "SMALL", *[0.8] * 7)], ["derived", "original", *lc.INDICATORS])
    out = lc.assembled(details, subs, ratios)
    return out.groupBy("food_category").agg(F.count("*").alias("n"), F.count("food_category_sub").alias("n_sub"), F.round(F.sum("weight"), 6).alias("weight"), F.sum("ghg").alias("ghg")).select("food_category", "n", "n_sub", "weight", rounded("ghg", 4))


_FOODS = """, foods AS (SELECT id AS product, CASE WHEN food_category IN ('SMALL', 'PROMO') THEN 'Fish' ELSE food_category END AS fc, food_category_sub AS s1, food_category_sub_sub AS s2, CASE WHEN pos % 2 = 0 THEN 'Organic' ELSE 'Not Organic' END AS organic, sum(true_percent) AS amount FROM ing GROUP BY ALL)"""


def _foods(spark, d):
    i = derived(spark, d, "ing")
    fc = F.when(F.col("food_category").isin("SMALL", "PROMO"), "Fish").otherwise(F.col("food_category"))
    i = i.withColumn("food_category", fc).withColumn("organic", F.when(F.col("pos") % 2 == 0, "Organic").otherwise("Not Organic"))
    return i.groupBy(F.col("id").alias("product"), *lc.CATEGORY, "organic").agg(F.sum("true_percent").alias("amount"))


def _lca(spark, d):
    fc = F.when(F.col("food_category") == "SMALL", "Fish").when(F.col("food_category") == "PROMO", "Fish (capture)").otherwise(F.col("food_category"))
    return mc.prepared(derived(spark, d, "lca").withColumn("food_category", fc))


def _draws_sql(reps: int) -> str:
    spots = []
    for depth, (s1, s2, cond) in enumerate((("''", "''", "true"), ("coalesce(s1, '')", "''", "s1 IS NOT NULL"), ("coalesce(s1, '')", "coalesce(s2, '')", "s2 IS NOT NULL"))):
        spots.append(f"SELECT *, {depth} AS depth, 'all' AS kind, 'all|' || fc || '|' || {s1} || '|' || {s2} AS pool FROM obs WHERE {cond}")
        spots.append(f"SELECT *, {depth}, CASE aq WHEN 'Yes' THEN 'aqua' ELSE 'wild' END, CASE aq WHEN 'Yes' THEN 'aqua|' ELSE 'wild|' END || fc || '|' || {s1} || '|' || {s2} FROM obs WHERE aq IS NOT NULL AND {cond}")
    spots.append("SELECT *, 0, 'organic', 'organic|' || fc || '|' || coalesce(s1, '') || '|' || CASE WHEN s1 IS NULL THEN '' ELSE coalesce(s2, '') END FROM obs WHERE sys = 'O'")
    key = "fc || '|' || coalesce(s1, '') || '|' || coalesce(s2, '')"
    mid, top = "fc || '|' || coalesce(s1, '') || '|'", "fc || '||'"
    look = lambda kind, *names: "coalesce(" + ", ".join(f"(SELECT max(pool) FROM have WHERE have.pool = '{kind}|' || {n})" for n in names) + ")"
    return ctes("ing", "lca") + _FOODS + f"""
    , obs AS (SELECT obs_id, CASE WHEN food_category IN ('SMALL', 'PROMO') THEN 'Fish' ELSE food_category END AS fc, food_category_sub AS s1, food_category_sub_sub AS s2, CASE food_category WHEN 'SMALL' THEN 'Yes' WHEN 'PROMO' THEN 'No' END AS aq, sys,
       CAST(round(weight * 1000000) + 100000 AS BIGINT) AS units, weight, ghg / 10 AS ghg, land / 10 AS land, eut / 10 AS eut, watscar / 10 AS watscar, biodiversity / 10 AS biodiversity, acidification / 10 AS acidification, wateruse / 10 AS wateruse FROM lca)
    , spots AS ({' UNION ALL '.join(spots)})
    , sized AS (SELECT *, count(*) OVER (PARTITION BY pool) AS size, CAST(sum(units) OVER (PARTITION BY pool) AS BIGINT) AS whole FROM spots)
    , rowsx AS (SELECT *, CAST(sum(units) OVER (PARTITION BY pool ORDER BY {key_number_sql("CAST(obs_id AS VARCHAR) || '|0'")} % 64, obs_id) AS BIGINT) AS high FROM sized WHERE (depth = 0 AND kind <> 'organic') OR size >= 5)
    , have AS (SELECT pool, max(size) AS size, max(whole) AS whole FROM rowsx GROUP BY 1)
    , combos AS (SELECT DISTINCT fc, s1, s2, organic FROM foods)
    , ch0 AS (SELECT *, {look('organic', key)} AS p_org, {look('all', key, mid, top)} AS p_all, {look('aqua', key, mid, top)} AS p_aqua, {look('wild', mid, top)} AS p_wild FROM combos)
    , ch AS (SELECT fc, s1, s2, organic, p_aqua AS pool, 1 AS lo, {reps // 2} AS hi FROM ch0 WHERE fc = 'Fish' AND p_aqua IS NOT NULL UNION ALL SELECT fc, s1, s2, organic, p_wild, {reps // 2 + 1}, {reps} FROM ch0 WHERE fc = 'Fish' AND p_wild IS NOT NULL
       UNION ALL SELECT fc, s1, s2, organic, CASE WHEN organic = 'Organic' AND p_org IS NOT NULL THEN p_org ELSE p_all END, 1, {reps} FROM ch0 WHERE fc <> 'Fish' AND (p_all IS NOT NULL))
    , dr AS (SELECT f.product, f.fc, f.s1, f.s2, f.organic, f.amount, CAST(rep AS INT) AS rep, ch.pool, have.whole FROM foods f JOIN ch ON ch.fc = f.fc AND ch.s1 IS NOT DISTINCT FROM f.s1 AND ch.s2 IS NOT DISTINCT FROM f.s2 AND ch.organic = f.organic
       JOIN have ON have.pool = ch.pool JOIN (SELECT unnest(range(1, {reps + 1})) AS rep) r ON rep BETWEEN lo AND hi)
    , pt AS (SELECT *, least(CAST(floor(CAST({draw_sql(['product', key_number_sql('pool'), 'rep'])} AS DOUBLE) / {float(MODULUS)}::DOUBLE * whole) AS BIGINT), whole - 1) AS point FROM dr)
    , hit AS (SELECT pt.*, o.obs_id, o.ghg, o.land, o.eut, o.watscar, o.biodiversity, o.acidification, o.wateruse FROM pt JOIN rowsx o ON o.pool = pt.pool AND pt.point >= o.high - o.units AND pt.point < o.high)
    """


#: Queries at all repetitions have no SQL; tests compare the same functions at a few with these statements.
AT_FEW: dict[str, tuple] = {}


def _at_all(name: str, sql):
    """Register ``fn(spark, d, reps)`` at all repetitions, and its SQL at a few."""

    def add(fn):
        query(name)(lambda spark, d: fn(spark, d, mc.REPETITIONS))
        AT_FEW[name] = (fn, sql)
        return fn

    return add


@_at_all("mc02_weighted_draws", lambda reps: _draws_sql(reps) + """SELECT product, fc AS food_category, s1 AS food_category_sub, s2 AS food_category_sub_sub, organic, pool, count(*) AS draws, count(DISTINCT obs_id) AS observations,
  min(obs_id) AS least_obs, max(obs_id) AS greatest_obs, min(point) AS low, max(point) AS high, CAST(sum(rep * obs_id % 1000003) AS BIGINT) AS checksum FROM hit GROUP BY ALL""")
def mc02(spark, d, reps):
    return sm.draw_counts(_foods(spark, d), _lca(spark, d), reps)


@_at_all("jon13_draw_points", lambda reps: _draws_sql(reps) + "SELECT pool, count(*) AS draws, CAST(min(point) AS BIGINT) AS low, CAST(max(point) AS BIGINT) AS high FROM hit GROUP BY 1")
def jon13(spark, d, reps):
    drawn = sm.draw_counts(_foods(spark, d), _lca(spark, d), reps)
    return drawn.groupBy("pool").agg(F.sum("draws").alias("draws"), F.min("low").alias("low"), F.max("high").alias("high"))


@query(
    "mc01_pools",
    _draws_sql(1) + "SELECT pool, max(size) AS size, max(whole) AS whole, CAST(max(depth) AS INT) AS depth FROM rowsx GROUP BY 1",
)
def mc01(spark, d):
    p = mc.pools(mc.replicated(_lca(spark, d)))
    return p.groupBy("pool").agg(F.max("size").alias("size"), F.max("whole").alias("whole"), F.max("depth").alias("depth"))


@query("jon12_depth_fallback", _draws_sql(1) + "SELECT fc AS food_category, s1 AS food_category_sub, s2 AS food_category_sub_sub, organic, pool FROM ch")
def jon12(spark, d):
    return mc.pool_choice(_foods(spark, d), mc.pools(mc.replicated(_lca(spark, d)))).select(*lc.CATEGORY, "organic", "pool")


@query("mc03_seafood_halves", _draws_sql(mc.REPETITIONS) + "SELECT product, split_part(pool, '|', 1) AS kind, CAST(sum(n) AS BIGINT) AS draws FROM (SELECT f.product, ch.pool, hi - lo + 1 AS n FROM foods f JOIN ch ON ch.fc = f.fc AND ch.s1 IS NOT DISTINCT FROM f.s1 AND ch.s2 IS NOT DISTINCT FROM f.s2 AND ch.organic = f.organic WHERE f.fc = 'Fish') GROUP BY 1, 2")
def mc03(spark, d):
    drawn = sm.draw_counts(_foods(spark, d).where("food_category = 'Fish'"), _lca(spark, d))
    return drawn.groupBy("product", F.substring_index("pool", "|", 1).alias("kind")).agg(F.sum("draws").alias("draws"))


@query("mc04_organic_pools", _draws_sql(mc.REPETITIONS) + "SELECT product, CAST(sum(hi - lo + 1) AS BIGINT) AS n FROM foods f JOIN ch ON ch.fc = f.fc AND ch.s1 IS NOT DISTINCT FROM f.s1 AND ch.s2 IS NOT DISTINCT FROM f.s2 AND ch.organic = f.organic WHERE ch.pool LIKE 'organic|%' GROUP BY 1")
def mc04(spark, d):
    drawn = sm.draw_counts(_foods(spark, d).where("organic = 'Organic'"), _lca(spark, d))
    return drawn.where("pool LIKE 'organic|%'").groupBy("product").agg(F.sum("draws").alias("n"))


def _brewed(spark, d):
    return _foods(spark, d).withColumn("brewed", F.when((F.col("product") % 3 == 0) & (F.col("food_category") == "LARGE"), "Coffee").when((F.col("product") % 3 == 1) & (F.col("food_category") == "LARGE"), "Tea").otherwise("No"))


_AMOUNT = "amount / 100 * CASE WHEN fc = 'LARGE' AND product % 3 = 0 THEN 0.06 WHEN fc = 'LARGE' AND product % 3 = 1 THEN 0.008 ELSE 1.0 END::DOUBLE"
_TOTALS = ", tot AS (SELECT product, rep, " + ", ".join(f"sum({i} * {_AMOUNT}) AS {i}" for i in lc.INDICATORS) + " FROM hit GROUP BY 1, 2)"


def _rank_sql(reps: int, by: str, columns) -> str:
    picks = ", ".join(f"{rounded_sql(f'max(CASE WHEN k = {max(1, round(reps * q))} THEN {i} END)', 6)} AS {n}_{i}" for n, q in mc.RANKS.items() for i in columns)
    return f", rk AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY round({by}, 9), rep) AS k FROM sc) SELECT product, {picks} FROM rk GROUP BY 1"


_SCORED = """, wm AS (SELECT fc, sum(ghg * weight) / sum(weight) AS ghg, sum(eut * weight) / sum(weight) AS eut, sum(watscar * weight) / sum(weight) AS watscar, sum(land * weight) / sum(weight) AS land FROM obs GROUP BY 1)
, mx AS (SELECT max(ghg) AS ghg, max(eut) AS eut, max(watscar) AS watscar, max(land) AS land FROM wm)
, sc AS (SELECT tot.*, (tot.ghg / mx.ghg + tot.eut / mx.eut + tot.watscar / mx.watscar + tot.land / mx.land) / 4 AS score FROM tot, mx)"""


def _statistics(spark, d, reps):
    return sm.statistics(_brewed(spark, d), _lca(spark, d), reps=reps)


@_at_all("mc05_product_totals", lambda reps: _draws_sql(reps) + _TOTALS + "SELECT product, CAST(count(*) AS DOUBLE) AS reps, " + ", ".join(f"{rounded_sql(f'{f}({i})', 6)} AS {n}_{i}" for n, f in (("mean", "avg"), ("least", "min"), ("most", "max")) for i in lc.INDICATORS) + " FROM tot GROUP BY 1")
def mc05(spark, d, reps):
    return _statistics(spark, d, reps).select("product", "reps", *[rounded(f"{n}_{i}", 6) for n in ("mean", "least", "most") for i in lc.INDICATORS])


@_at_all("mc06_composite", lambda reps: _draws_sql(reps) + _TOTALS + _SCORED + "SELECT product, " + ", ".join(f"{rounded_sql(f'{f}(score)', 6)} AS {n}_score" for n, f in (("mean", "avg"), ("least", "min"), ("most", "max"))) + " FROM sc GROUP BY 1")
def mc06(spark, d, reps):
    return _statistics(spark, d, reps).select("product", *[rounded(f"{n}_score", 6) for n in ("mean", "least", "most")])


def _mc07_sql(reps: int) -> str:
    n, z = reps - 1, su.Z_975  # the expansion that the query uses; listed for few degrees of freedom
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    t = su.T_975[n - 1] if n <= len(su.T_975) else z + sum(x / n ** (i + 1) for i, x in enumerate(terms))
    half = lambda i: f"{t} * stddev_samp({i}) / sqrt({reps})"
    told = ", ".join(f"{rounded_sql(f'avg({i})', 6)} AS mean_{i}, {rounded_sql(f'stddev_samp({i}) / sqrt({reps})', 6)} AS se_{i}, {rounded_sql(f'avg({i}) - {half(i)}', 4)} AS lower_ci_{i}, {rounded_sql(f'avg({i}) + {half(i)}', 4)} AS upper_ci_{i}" for i in lc.INDICATORS)
    return f"{_draws_sql(reps)}{_TOTALS} SELECT product, {told} FROM tot GROUP BY 1"


@_at_all("mc07_statistics", _mc07_sql)
def mc07(spark, d, reps):
    made = _statistics(spark, d, reps)
    return made.select("product", *[rounded(f"{n}_{i}", k) for i in lc.INDICATORS for n, k in (("mean", 6), ("se", 6), ("lower_ci", 4), ("upper_ci", 4))])


@_at_all("win05_rank_rows", lambda reps: _draws_sql(reps) + _TOTALS + _SCORED + _rank_sql(reps, "score", lc.INDICATORS))
def win05(spark, d, reps):
    return _statistics(spark, d, reps).select("product", *[rounded(f"{n}_{i}", 6) for n in mc.RANKS for i in lc.INDICATORS])


@_at_all(
    "mc08_contributions",
    lambda reps: _draws_sql(reps) + f", p AS (SELECT product, fc, sum(CAST(ghg * {_AMOUNT} AS DECIMAL(28,12))) AS ghg, sum(CAST(land * {_AMOUNT} AS DECIMAL(28,12))) AS land, sum(CAST(amount AS DECIMAL(28,12))) AS amount FROM hit GROUP BY 1, 2) SELECT product, fc AS food_category, {rounded_sql('ghg::DOUBLE / (sum(ghg) OVER w)::DOUBLE', 6)} AS ghg, {rounded_sql('land::DOUBLE / (sum(land) OVER w)::DOUBLE', 6)} AS land, {rounded_sql('amount::DOUBLE / (sum(amount) OVER w)::DOUBLE', 6)} AS amount FROM p WINDOW w AS (PARTITION BY product)",
)
def mc08(spark, d, reps):
    made = sm.contributions(_brewed(spark, d), _lca(spark, d), reps=reps, indicators=["ghg", "land"])
    return made.select("product", "food_category", *[rounded(c, 6) for c in ("ghg", "land", "amount")])


@query("ord04_weighted_sample", "SELECT p_partkey, round(" + uniform_sql(["p_partkey", "p_size"]) + ", 9) AS u FROM part")
def ord04(spark, d):
    return derived(spark, d, "part").select("p_partkey", F.round(F.expr(uniform_sql(["p_partkey", "p_size"])), 9).alias("u"))


@query(
    "env05_food_frame",
    ctes("ing") + """, x AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'Organic' ELSE 'Not Organic' END AS organic, true_percent - CASE WHEN id % 11 = 0 AND pos = 1 THEN 200 ELSE 0 END AS percent, CASE WHEN food_category = 'LARGE' THEN 'Coffee' WHEN food_category = 'PROMO' THEN 'Mineral' ELSE food_category END AS c FROM ing)
    SELECT id, CASE WHEN c <> 'Mineral' THEN c END AS food_category, food_category_sub, food_category_sub_sub, organic, round(sum(percent), 6) AS amount, CASE WHEN id % 4 = 0 AND c = 'Coffee' AND sum(percent) >= 10 THEN 'Coffee' ELSE 'No' END AS brewed FROM x
    WHERE id NOT IN (SELECT id FROM x WHERE percent <= 0) GROUP BY id, c, food_category_sub, food_category_sub_sub, organic""",
)
def env05(spark, d):
    i = derived(spark, d, "ing")
    c = F.when(F.col("food_category") == "LARGE", "Coffee").when(F.col("food_category") == "PROMO", "Mineral").otherwise(F.col("food_category"))
    i = i.withColumn("percent", F.col("true_percent") - F.when((F.col("id") % 11 == 0) & (F.col("pos") == 1), 200).otherwise(0)).withColumn("food_category", c)
    i = i.withColumn("organic", F.when(F.col("id") % 3 == 0, "Organic").otherwise("Not Organic"))
    out = im.food_frame(i, ["id"], i.where("id % 4 = 0"))
    return _r(out, ["id", *lc.CATEGORY, "organic", "brewed"], "amount")


_NUTRIENTS = """, nt AS (SELECT food_category, avg(land) AS calories, avg(eut) AS protein, avg(ghg) AS fat, avg(wateruse) AS saturated_fat, avg(acidification) AS fiber, avg(watscar) AS sodium, avg(biodiversity) AS carbohydrates FROM lca GROUP BY 1)"""


def _nutrients(spark, d):
    names = {"land": "calories", "eut": "protein", "ghg": "fat", "wateruse": "saturated_fat", "acidification": "fiber", "watscar": "sodium", "biodiversity": "carbohydrates"}
    return derived(spark, d, "lca").groupBy("food_category").agg(*[F.avg(a).alias(b) for a, b in names.items()])


@query(
    "nut01_estimated",
    ctes("ing", "lca") + _NUTRIENTS + """, x AS (SELECT id, true_percent AS p, CASE WHEN food_category = 'SMALL' THEN 'Salt' ELSE food_category END AS c FROM ing)
    SELECT id, round(coalesce(sum(calories * p / 100), 0), 6) AS calories, round(coalesce(sum(protein * p / 100), 0), 6) AS protein, round(coalesce(sum(CASE WHEN c = 'Salt' THEN p * 400 ELSE sodium * p / 100 END), 0), 5) AS sodium FROM x LEFT JOIN nt ON nt.food_category = x.c GROUP BY 1""",
)
def nut01(spark, d):
    i = derived(spark, d, "ing").withColumn("percent", F.col("true_percent")).withColumn("food_category", F.when(F.col("food_category") == "SMALL", "Salt").otherwise(F.col("food_category")))
    out = im.estimated_nutrients(i, _nutrients(spark, d), ["id"])
    return out.select("id", F.round("calories", 6).alias("calories"), F.round("protein", 6).alias("protein"), F.round("sodium", 5).alias("sodium"))


@query(
    "nut02_fruit_and_sugar",
    ctes("ing") + "SELECT id, round(sum(CASE WHEN food_category = 'SMALL' OR value LIKE '%gizmo%' THEN true_percent ELSE 0 END), 6) AS fvno, round(sum(CASE WHEN food_category = 'PROMO' AND value NOT LIKE '%gizmo%' THEN true_percent ELSE 0 END), 6) AS sugar FROM ing GROUP BY 1",
)
def nut02(spark, d):
    c = F.when(F.col("food_category") == "SMALL", "Nuts").when(F.col("food_category") == "PROMO", "Beet Sugar").otherwise(F.col("food_category"))
    i = derived(spark, d, "ing").withColumn("percent", F.col("true_percent")).withColumn("food_category", c).withColumn("value", F.replace("value", F.lit("gizmo"), F.lit("walnut pure oil")))
    return _r(im.fruit_and_sugar(i, ["id"]), ["id"], "fvno", "sugar")


@query("nut03_identified", ctes("ing") + "SELECT id, round(sum(true_percent), 6) AS tot_percent FROM ing WHERE food_category <> 'SMALL' GROUP BY 1 HAVING round(sum(true_percent), 9) >= 75")
def nut03(spark, d):
    i = derived(spark, d, "ing").withColumn("percent", F.col("true_percent")).withColumn("food_category", F.when(F.col("food_category") != "SMALL", F.col("food_category")))
    return _r(im.identified(i, ["id"]), ["id"], "tot_percent")


_PACK_COLS = {"sugar": "sugar", "fat": "fat", "saturated_fat": "saturated_fat * 1.2", "salt": "sodium / 8", "protein": "protein", "fiber": "fiber", "carbohydrates": "fvno", "energy": "calories"}


@query(
    "nut04_pack",
    ctes("nut") + ", m AS (SELECT product_name, " + ", ".join(f"avg(CASE WHEN id % 3 <> 0 THEN {e} END) AS {n}" for n, e in _PACK_COLS.items()) + """ FROM nut GROUP BY 1)
    , g AS (SELECT *, sugar > 100 OR fat > 100 OR saturated_fat > 100 OR salt > 100 OR protein > 100 OR fiber > 100 OR carbohydrates > 100 OR saturated_fat > fat + 5 AS bad FROM m)
    , z AS (SELECT n.id, CASE WHEN NOT coalesce(bad, false) THEN coalesce(g.fat, n.fat) ELSE n.fat END AS fat, CASE WHEN NOT coalesce(bad, false) THEN coalesce(g.protein, n.protein) ELSE n.protein END AS protein,
        CASE WHEN NOT coalesce(bad, false) THEN coalesce(g.carbohydrates, n.fvno) ELSE n.fvno END AS carbohydrates, CASE WHEN NOT coalesce(bad, false) THEN coalesce(g.salt * 400, n.sodium) ELSE n.sodium END AS sodium FROM nut n LEFT JOIN g ON g.product_name = n.product_name)
    SELECT id, round(fat, 6) AS fat, round(sodium, 6) AS sodium, round(fat * 8.84 + carbohydrates * 4 + protein * 4, 5) AS calories FROM z""",
)
def nut04(spark, d):
    n = derived(spark, d, "nut")
    packs = n.select("product_name", *[F.when(F.col("id") % 3 != 0, F.expr(e)).alias(f"{k}_pack") for k, e in _PACK_COLS.items()])
    out = im.with_pack_nutrition(n.withColumn("carbohydrates", F.col("fvno")), packs)
    return out.select("id", F.round("fat", 6).alias("fat"), F.round("sodium", 6).alias("sodium"), F.round("calories", 5).alias("calories"))


@query(
    "nut05_product_types",
    ctes("ingprod") + """, c AS (SELECT id, sum(CASE WHEN food_category = 'SMALL' THEN true_percent ELSE 0 END) AS w FROM ingprod GROUP BY 1), p AS (SELECT DISTINCT id, product_name, department, aisle, shelf FROM ingprod)
    SELECT p.product_name, CASE WHEN max(CASE WHEN department = '1-URGENT' OR w >= 90 THEN 1 ELSE 0 END) = 1 THEN 'Drinks' ELSE 'No' END AS drinks,
      CASE WHEN max(CASE WHEN department <> '1-URGENT' AND aisle = 'BUILDING' THEN 1 ELSE 0 END) = 1 THEN 'Alcohol' ELSE 'No' END AS alcohol, 'No' AS cheese, CASE WHEN max(CASE WHEN shelf = 'P' THEN 1 ELSE 0 END) = 1 THEN 'Fats.Oils' ELSE 'No' END AS fat_oil FROM p JOIN c ON c.id = p.id GROUP BY 1""",
)
def nut05(spark, d):
    i = derived(spark, d, "ingprod").withColumn("percent", F.col("true_percent")).withColumn("food_category", F.when(F.col("food_category") == "SMALL", "Water").otherwise(F.col("food_category")))
    return im.product_types(i, i, ["1-URGENT"], ["BUILDING"], ["P"])


def _based(spark, d):
    n = derived(spark, d, "nut").withColumns({"ghg_100g": F.col("fvno") + 1, "land_100g": F.col("sodium") + 1, "serving_value": F.col("sugar") * 5})
    return im.per_basis(n, ["ghg", "land"])


_BASED = ctes("nut") + """, b AS (SELECT id, fvno + 1 AS ghg_100g, sodium + 1 AS land_100g, (fvno + 1) * sugar * 5 / 100 AS ghg_serving, (sodium + 1) * sugar * 5 / 100 AS land_serving, (fvno + 1) / nullif(protein / 10, 0) AS ghg_protein, (sodium + 1) / nullif(protein / 10, 0) AS land_protein,
  (fvno + 1) / nullif(calories / 100, 0) AS ghg_calories, (sodium + 1) / nullif(calories / 100, 0) AS land_calories, drinks FROM nut)"""


@query("nut07_per_basis", _BASED + "SELECT id, round(ghg_serving, 6) AS ghg_serving, round(ghg_protein, 6) AS ghg_protein, round(land_calories, 6) AS land_calories FROM b")
def nut07(spark, d):
    return _r(_based(spark, d), ["id"], "ghg_serving", "ghg_protein", "land_calories")


@query(
    "nut08_serving_imputed",
    ctes("prod") + """, x AS (SELECT *, CASE WHEN id % 4 <> 0 AND shelf <> 'P' THEN CAST(id % 300 AS DOUBLE) END AS v, 'name ' || CAST(id % 500 AS VARCHAR) AS nm FROM prod)
    , y AS (SELECT nm, coalesce(v, avg(v) OVER (PARTITION BY retailer, department, aisle, shelf), avg(v) OVER (PARTITION BY retailer, department, aisle), avg(v) OVER (PARTITION BY retailer, department)) AS v FROM x)
    SELECT nm AS product_name, round(avg(v), 6) AS serving_value FROM y GROUP BY 1""",
)
def nut08(spark, d):
    p = derived(spark, d, "prod").withColumn("serving_value", F.when((F.col("id") % 4 != 0) & (F.col("shelf") != "P"), (F.col("id") % 300).cast("double")))
    p = p.withColumn("product_name", F.concat(F.lit("name "), (F.col("id") % 500).cast("string")))
    return _r(im.imputed_serving(p), ["product_name"], "serving_value")


@query(
    "nut09_scaled_bases",
    _BASED + "SELECT id, round((ghg_100g / (SELECT max(ghg_100g) FROM b) + land_100g / (SELECT max(land_100g) FROM b)) / 2, 6) AS total_100g_scaled, round((ghg_protein / (SELECT max(ghg_protein) FROM b) + land_protein / (SELECT max(land_protein) FROM b)) / 2, 6) AS total_protein_scaled FROM b",
)
def nut09(spark, d):
    return _r(im.scaled_bases(_based(spark, d), ["ghg", "land"]), ["id"], "total_100g_scaled", "total_protein_scaled")


@query(
    "nut10_scaled_statistics",
    ctes("nut") + """, s AS (SELECT id, fvno AS mean_ghg, sodium AS mean_land, fvno * 2 AS max_ghg, sodium * 3 AS max_land, CAST(id % 40 - 10 AS INT) AS score_points FROM nut)
    , t AS (SELECT *, mean_ghg / (SELECT max(mean_ghg) FROM s) * 100 AS a, mean_land / (SELECT max(mean_land) FROM s) * 100 AS b, max_ghg / (SELECT max(mean_ghg) FROM s) * 100 AS c, max_land / (SELECT max(mean_land) FROM s) * 100 AS e FROM s)
    SELECT id, round(c, 6) AS scaled_max_ghg, round((a + b) / 2 / (SELECT max((a + b) / 2) FROM t) * 100, 6) AS total_scaled_mean, round((c + e) / 2 / (SELECT max((a + b) / 2) FROM t) * 100, 6) AS total_scaled_max,
      round((score_points + (SELECT abs(min(score_points)) FROM s)) / CAST((SELECT max(score_points) + abs(min(score_points)) FROM s) AS DOUBLE) * 100, 6) AS score_scaled FROM t""",
)
def nut10(spark, d):
    s = derived(spark, d, "nut").select(
        "id", F.col("fvno").alias("mean_ghg"), F.col("sodium").alias("mean_land"), (F.col("fvno") * 2).alias("max_ghg"), (F.col("sodium") * 3).alias("max_land"), (F.col("id") % 40 - 10).cast("int").alias("score_points")
    )
    out = im.scaled_statistics(s, ["ghg", "land"], ["mean", "max"])
    return _r(out, ["id"], "scaled_max_ghg", "total_scaled_mean", "total_scaled_max", "score_scaled")


_NAMED = "CASE id % 5 WHEN 0 THEN 'Smoked dinner' WHEN 1 THEN 'Wholegrain rolls' ELSE 'dinner ' || CAST(id AS VARCHAR) END"
_GROUPED = "CASE food_category WHEN 'SMALL' THEN 'Pig Meat' WHEN 'PROMO' THEN 'Rice' WHEN 'LARGE' THEN 'Apples' WHEN 'MEDIUM' THEN 'Milk' WHEN 'ECONOMY' THEN 'Poultry Meat' ELSE 'Unknown' END"
_RR = ctes("ing") + f""", g AS (SELECT id, pos, {_NAMED} AS product_name, value || CASE WHEN pos = 2 THEN ' bacon' ELSE '' END AS value, true_percent AS percent, {_GROUPED} AS c FROM ing)
, r AS (SELECT *, CASE WHEN c IN ('Pig Meat', 'Poultry Meat') AND (value LIKE '%bacon%' OR product_name LIKE 'Smoked%') THEN 'Processed red meat' WHEN c = 'Rice' AND product_name LIKE 'Wholegrain%' THEN 'Whole grains'
  WHEN c = 'Pig Meat' THEN 'Unprocessed red meat' WHEN c = 'Rice' THEN 'Refined grains' WHEN c = 'Apples' THEN 'Fruits' WHEN c = 'Milk' THEN 'Dairy' WHEN c = 'Poultry Meat' THEN 'Chicken' END AS rr_group FROM g)"""


def _risky(spark, d):
    i = derived(spark, d, "ing").withColumn("product_name", F.expr(_NAMED.replace("VARCHAR", "STRING"))).withColumn("value", F.concat("value", F.when(F.col("pos") == 2, " bacon").otherwise("")))
    i = i.withColumn("food_category", F.expr(_GROUPED)).withColumn("percent", F.col("true_percent"))
    return i.withColumn("rr_group", he.risk_group(F.col("value"), F.col("product_name"), F.col("food_category")))


@query("hlt01_risk_group", _RR + "SELECT id, pos, rr_group FROM r")
def hlt01(spark, d):
    return _risky(spark, d).select("id", "pos", "rr_group")


RISK_ROWS = [("Processed red meat", "ACM", 1.2, 1.1, 1.3), ("Whole grains", "ACM", 0.9, 0.85, 0.95), ("Fruits", "ACM", 0.94, 0.9, 0.97), ("SSBs", "ACM", 1.1, 1.05, 1.2), ("Fruits", "CHD", 0.92, 0.9, 0.95)]


@query(
    "hlt02_relative_risk",
    _RR + """, t(rr_group, outcome, m, lo, hi, s) AS (VALUES ('Processed red meat', 'ACM', 1.2, 1.1, 1.3, 50), ('Whole grains', 'ACM', 0.9, 0.85, 0.95, 30), ('Fruits', 'ACM', 0.94, 0.9, 0.97, 100), ('SSBs', 'ACM', 1.1, 1.05, 1.2, 225), ('Fruits', 'CHD', 0.92, 0.9, 0.95, 100))
    , a AS (SELECT product_name, rr_group, sum(p) AS p FROM (SELECT product_name, rr_group, lower(value) AS v, avg(percent) AS p FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2)
    , w AS (SELECT product_name, CASE WHEN product_name IN (SELECT product_name FROM g WHERE id % 7 = 3) THEN 'SSBs' ELSE rr_group END AS rr_group, least(p, 100) / 100 AS p FROM a WHERE rr_group IS NOT NULL)
    SELECT product_name, outcome, round(exp(sum(ln(power(coalesce(power(CAST(m AS DOUBLE), 100.0 / s), 1), p)))), 6) AS mean_rr, round(exp(sum(ln(power(coalesce(power(CAST(hi AS DOUBLE), 100.0 / s), 1), p)))), 6) AS upper_rr FROM w LEFT JOIN t ON t.rr_group = w.rr_group GROUP BY 1, 2""",
)
def hlt02(spark, d):
    i = _risky(spark, d)
    risks = spark.createDataFrame(RISK_ROWS, "rr_group string, outcome string, mean_rr double, lower_rr double, upper_rr double")
    out = he.relative_risk(i, risks, sweet_drinks=i.where("id % 7 = 3"))
    return _r(out, ["product_name", "outcome"], "mean_rr", "upper_rr")
