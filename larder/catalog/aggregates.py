"""Aggregation and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.catalog.registry import query, rounded, rounded_sql
from larder.fixtures import ctes, derived
from larder.operators import regression as rg
from larder.operators import relational as r
from larder.operators import sketches as sk
from larder.operators import summaries as s


# 97.5% point of Student's t for more than ten degrees of freedom n - 1
T_SQL = (
    "(z + (z**3 + z) / 4 / (n-1) + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (n-1)**2 + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / (n-1)**3 "
    "+ (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160 / (n-1)**4)"
).replace("z", "1.959963984540054::DOUBLE")


@query(
    "agg01_group",
    "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 6) AS mean_quantity, count(*) AS n, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1, 2",
)
def agg01(spark, d):
    return derived(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"),
        F.count("*").alias("n"), F.min("l_discount").alias("lo"), F.max("l_tax").alias("hi"),
    )


@query(
    "agg02_mean_over_years",
    ctes("flow") + "SELECT item, exporter, importer, round(avg(import_rep), 6) AS qty FROM flow GROUP BY 1, 2, 3",
)
def agg02(spark, d):
    return derived(spark, d, "flow").groupBy("item", "exporter", "importer").agg(F.round(F.avg("import_rep"), 6).alias("qty"))


@query(
    "agg03_pivot",
    ctes("supply_use") + """SELECT area_code, item, round(sum(CASE WHEN element = 'Food' THEN value END), 6) AS "Food", round(sum(CASE WHEN element = 'Feed' THEN value END), 6) AS "Feed",
      round(sum(CASE WHEN element = 'Processed' THEN value END), 6) AS "Processed" FROM supply_use GROUP BY 1, 2""",
)
def agg03(spark, d):
    names = ["Food", "Feed", "Processed"]
    wide = derived(spark, d, "supply_use").groupBy("area_code", "item").pivot("element", names).agg(F.sum("value"))
    return wide.select("area_code", "item", *[F.round(n, 6).alias(n) for n in names])


@query(
    "agg04_unpivot",
    ctes("lca") + "SELECT obs_id, 'ghg' AS indicator, ghg AS value FROM lca UNION ALL SELECT obs_id, 'land', land FROM lca UNION ALL SELECT obs_id, 'eut', eut FROM lca",
)
def agg04(spark, d):
    return derived(spark, d, "lca").unpivot(["obs_id"], ["ghg", "land", "eut"], "indicator", "value")


@query(
    "agg05_supported_mean",
    ctes("ingprod") + """SELECT aisle, shelf, food_category, pos, CASE WHEN avg(percent0) <= 100.0 / pos THEN round(avg(percent0), 9) END AS mean_percent FROM ingprod
      GROUP BY 1, 2, 3, 4 HAVING sum(CASE WHEN percent0 IS NOT NULL AND percent0 <> 0 THEN 1 ELSE 0 END) >= 10""",
)
def agg05(spark, d):
    out = s.supported_mean(derived(spark, d, "ingprod"), ["aisle", "shelf", "food_category"], "pos", "percent0")
    return out.withColumn("mean_percent", F.round("mean_percent", 9))


@query(
    "agg06_minimum_frequency",
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12)",
)
def agg06(spark, d):
    return r.minimum_frequency(derived(spark, d, "orders"), ["o_custkey"], 12).select("o_orderkey")


@query("agg07_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def agg07(spark, d):
    return derived(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("agg08_value_counts", "SELECT p_name, count(*) AS n FROM part GROUP BY 1")
def agg08(spark, d):
    return s.value_counts(derived(spark, d, "part"), "p_name")


@query("agg09_children", "SELECT p_type, array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS children FROM part GROUP BY 1")
def agg09(spark, d):
    return s.children(derived(spark, d, "part"), "p_type", "p_brand").select("p_type", F.array_join("children", "|").alias("children"))


_AL = "CASE WHEN 2 * abs(import_rep - export_rep) / (import_rep + export_rep) = 2 AND import_rep < 10 AND export_rep < 10 THEN -1 ELSE 2 * abs(import_rep - export_rep) / (import_rep + export_rep) END"


@query(
    "agg10_reliability",
    ctes("flow") + f"""SELECT item, yr, importer, round(coalesce(sum(CASE WHEN al <> -1 AND al <= 0.2 THEN import_rep END), 0) / nullif(sum(CASE WHEN al <> -1 THEN import_rep END), 0), 6) AS rim
      FROM (SELECT *, {_AL} AS al FROM flow WHERE import_rep <> 0 OR export_rep <> 0) GROUP BY 1, 2, 3""",
)
def agg10(spark, d):
    from larder.operators.trade import accuracy_level

    f = derived(spark, d, "flow").withColumn("al", accuracy_level(F.col("import_rep"), F.col("export_rep")))
    good = F.coalesce(F.sum(F.when((F.col("al") != -1) & (F.col("al") <= 0.2), F.col("import_rep"))), F.lit(0.0))
    return f.groupBy("item", "yr", "importer").agg(F.round(F.try_divide(good, F.sum(F.when(F.col("al") != -1, F.col("import_rep")))), 6).alias("rim"))


@query("agg11_shares", ctes("lca") + "SELECT obs_id, round(weight / sum(weight) OVER (PARTITION BY food_category) * 100, 6) AS share FROM lca")
def agg11(spark, d):
    return s.shares(derived(spark, d, "lca"), ["food_category"], "weight").select("obs_id", F.round("share", 6).alias("share"))


@query(
    "agg12_weighted_mean",
    ctes("lca") + "SELECT food_category, round(sum(ghg * weight) / sum(weight), 6) AS ghg, round(sum(land * weight) / sum(weight), 6) AS land FROM lca GROUP BY 1",
)
def agg12(spark, d):
    out = s.weighted_mean(derived(spark, d, "lca"), ["food_category"], ["ghg", "land"], "weight")
    return out.select("food_category", F.round("ghg", 6).alias("ghg"), F.round("land", 6).alias("land"))


@query(
    "agg13_proportions",
    ctes("ing") + """SELECT id, food_category, round(sum(true_percent) / sum(sum(true_percent)) OVER (PARTITION BY id), 6) AS true_percent,
      round(sum(pos) / sum(sum(pos)) OVER (PARTITION BY id), 6) AS pos FROM ing GROUP BY id, food_category""",
)
def agg13(spark, d):
    out = s.proportions(derived(spark, d, "ing"), ["id"], ["food_category"], ["true_percent", "pos"])
    return out.select("id", "food_category", F.round("true_percent", 6).alias("true_percent"), F.round("pos", 6).alias("pos"))


@query("agg14_row_sum", ctes("ing") + "SELECT id, rep, round(sum(true_percent * (pos + rep)), 4) AS total FROM ing, (SELECT unnest(range(1, 4)) AS rep) GROUP BY 1, 2")
def agg14(spark, d):
    reps = derived(spark, d, "ing").withColumn("rep", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))))
    return reps.groupBy("id", "rep").agg(F.round(F.sum(F.col("true_percent") * (F.col("pos") + F.col("rep"))), 4).alias("total"))


@query(
    "agg15_interval",
    "SELECT p_type, n, round(m, 6) AS mean_x, round(sd / sqrt(n), 6) AS se_x, round(m - t * sd / sqrt(n), 5) AS lower_ci_x, round(m + t * sd / sqrt(n), 5) AS upper_ci_x FROM "
    f"(SELECT p_type, n, m, sd, {T_SQL} AS t FROM (SELECT p_type, count(*) AS n, avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS sd FROM part GROUP BY 1))",
)
def agg15(spark, d):
    out = s.mean_with_interval(derived(spark, d, "part").withColumnRenamed("p_retailprice", "x"), ["p_type"], ["x"])
    return out.select("p_type", "n", F.round("mean_x", 6).alias("mean_x"), F.round("se_x", 6).alias("se_x"), F.round("lower_ci_x", 5).alias("lower_ci_x"), F.round("upper_ci_x", 5).alias("upper_ci_x"))


_PROFILED = ["l_quantity", "l_extendedprice", "l_partkey", "l_suppkey"]


def _ranks_sql(c: str) -> str:
    return f"SELECT '{c}' AS \"column\", count({c}) AS n, round(min({c}), 6)::DOUBLE AS least, round(max({c}), 6)::DOUBLE AS most, round(avg({c}), 4) AS mean, true AS distinct_holds, true AS quantiles_hold FROM lineitem"


@query("agg16_sketched_profile", " UNION ALL ".join(_ranks_sql(c) for c in _PROFILED))
def agg16_sketched(spark, d):
    """Merged sketches of the table's parts, and whether they keep their bounds against exact counts and ranks."""
    lines = derived(spark, d, "lineitem")
    parts = sk.sketched(lines, ["l_returnflag", "l_linestatus"], _PROFILED)
    told = sk.described(sk.merged(parts, []), [])
    exact = lines.agg(*[F.countDistinct(c).alias(c) for c in _PROFILED]).unpivot([], _PROFILED, "column", "exact")
    long = lines.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in _PROFILED])).alias("x")).select("x.*").where("v IS NOT NULL")
    # one row of ranks per profiled column: rows stay where they are
    bounds = long.join(F.broadcast(told.select("column", "q25", "q50", "q75")), "column").groupBy("column").agg(*[f(F.avg((F.col("v") < F.col(q)).cast("double")), F.avg((F.col("v") <= F.col(q)).cast("double"))).alias(f"hold{q}") for q, f in
        [(q, lambda low, high, p=p: (low <= p + sk.RANK_ERROR) & (high >= p - sk.RANK_ERROR)) for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]])
    out = told.join(exact, "column").join(bounds, "column")
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.col("exact") * sk.DISTINCT_ERROR, F.lit(1))
    return out.select("column", "n", F.round("least", 6).alias("least"), F.round("most", 6).alias("most"), F.round("mean", 4).alias("mean"), near.alias("distinct_holds"), (F.col("holdq25") & F.col("holdq50") & F.col("holdq75")).alias("quantiles_hold"))


def _described(c):
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, "
        f"round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75 FROM ing"
    )


@query("agg16_describe", ctes("ing") + _described("true_percent") + " UNION ALL " + _described("percent0"))
def agg16(spark, d):
    out = s.describe(derived(spark, d, "ing"), ["true_percent", "percent0"])
    return out.select("column", "n", *[F.round(c, 6).alias(c) for c in ("null_share", "mean", "sd", "min", "max", "q25", "median", "q75")])


@query("agg17_histogram", "SELECT CAST(least(floor((value - 0) / 2.0) + 1, 100) AS INT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 200 GROUP BY 1")
def agg17(spark, d):
    return s.histogram(derived(spark, d, "events"), "value", 0.0, 200.0, 100)


@query(
    "agg18_count_mean",
    "SELECT quality, toxic, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2",
)
def agg18(spark, d):
    both = derived(spark, d, "labels").join(derived(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("agg19_log_product", ctes("ing") + f"SELECT id, {rounded_sql('exp(sum(ln(1 + true_percent / 100)))', 6)} AS x FROM ing GROUP BY 1")
def agg19(spark, d):
    i = derived(spark, d, "ing").withColumn("x", 1 + F.col("true_percent") / 100)
    return s.product_of(i, ["id"], ["x"]).select("id", rounded("x", 6))


_ERR = {"shelf": "aisle, shelf", "aisle": "aisle", "dep": "department"}


@query(
    "agg21_log_error",
    ctes("ingprod") + """, m AS (SELECT id, aisle, department, percent0 AS p, avg(percent0) OVER (PARTITION BY aisle, pos) AS a, avg(percent0) OVER (PARTITION BY department, pos) AS e FROM ingprod)
    SELECT aisle, round(avg(abs(log2(p / a))), 6) AS aisle_error, round(avg(abs(log2(p / e))), 6) AS department_error FROM m GROUP BY 1""",
)
def agg21(spark, d):
    i = derived(spark, d, "ingprod")
    i = r.with_totals(i, ["aisle", "pos"], a=F.avg("percent0"))
    i = r.with_totals(i, ["department", "pos"], e=F.avg("percent0"))
    error = lambda x: F.round(F.avg(F.abs(F.log2(F.col("percent0") / F.col(x)))), 6)
    return i.groupBy("aisle").agg(error("a").alias("aisle_error"), error("e").alias("department_error"))


@query(
    "agg22_two_step",
    ctes("ing") + "SELECT id, food_category, round(sum(p), 6) AS true_percent FROM (SELECT id, food_category, value, avg(true_percent) AS p FROM ing GROUP BY 1, 2, 3) GROUP BY 1, 2",
)
def agg22(spark, d):
    return s.two_step_sum(derived(spark, d, "ing"), ["id", "food_category"], "value", "true_percent").withColumn("true_percent", F.round("true_percent", 6))


@query("agg23_global_max", "SELECT p_partkey, round(p_retailprice / (SELECT max(p_retailprice) FROM part) * 100, 6) AS scaled FROM part")
def agg23(spark, d):
    out = s.scaled_by_max(derived(spark, d, "part"), ["p_retailprice"], 100.0)
    return out.select("p_partkey", F.round("p_retailprice_scaled", 6).alias("scaled"))


@query("agg24_subset_max", "SELECT p_partkey, round(p_retailprice / (SELECT max(p_retailprice) FROM part WHERE p_type = 'SMALL'), 6) AS scaled FROM part")
def agg24(spark, d):
    out = s.scaled_by_max(derived(spark, d, "part"), ["p_retailprice"], among=F.col("p_type") == "SMALL")
    return out.select("p_partkey", F.round("p_retailprice_scaled", 6).alias("scaled"))


@query(
    "win11_best_column",
    ctes("lca") + "SELECT obs_id, least(land, eut, watscar) AS best, CASE WHEN land <= eut AND land <= watscar THEN 'land' WHEN eut <= watscar THEN 'eut' ELSE 'watscar' END AS name FROM lca",
)
def win11(spark, d):
    smallest, name = s.best_of(["land", "eut", "watscar"])
    return derived(spark, d, "lca").select("obs_id", smallest.alias("best"), name.alias("name"))


@query(
    "cmp13_position_means",
    ctes("ingprod") + """SELECT department, aisle, shelf, pos, round(avg(percent0), 9) AS mean_percent, count(percent0) AS n, CAST(3 - grouping(aisle) - grouping(shelf) AS INT) AS depth
      FROM ingprod GROUP BY GROUPING SETS ((department, pos), (department, aisle, pos), (department, aisle, shelf, pos))""",
)
def cmp13(spark, d):
    out = s.position_means(derived(spark, d, "ingprod"), "pos", "percent0", ["department", "aisle", "shelf"])
    return out.withColumn("mean_percent", F.round("mean_percent", 9))


_REG = """
, g AS (SELECT retailer, department, aisle, count(percent0) AS n, sum(percent0) AS y, sum(percent0 * percent0) AS yy,
    sum(CASE WHEN percent0 IS NOT NULL THEN 1.0 / pos END) AS x2, sum(CASE WHEN percent0 IS NOT NULL THEN 1.0 / (pos * pos) END) AS xx2, sum(percent0 / pos) AS xy2,
    sum(CASE WHEN percent0 IS NOT NULL THEN 1.0 / (pos * pos * pos * pos) END) AS xx1, sum(percent0 / (pos * pos)) AS xy1,
    sum(CASE WHEN percent0 IS NOT NULL THEN pos END) AS x3, sum(CASE WHEN percent0 IS NOT NULL THEN pos * pos END) AS xx3, sum(percent0 * pos) AS xy3,
    count(DISTINCT CASE WHEN percent0 IS NOT NULL THEN pos END) AS seen, max(pos) AS last FROM ingprod WHERE pos <= 15 GROUP BY 1, 2, 3)
, f AS (SELECT *, xy1 / nullif(xx1, 0) AS b1, xy2 / nullif(xx2, 0) AS b2, (xy3 - x3 * y / nullif(n, 0)) / nullif(xx3 - x3 * x3 * 1.0 / nullif(n, 0), 0) AS b3 FROM g)
, a AS (SELECT *, CASE WHEN b1 IS NOT NULL THEN 1 - greatest(yy - b1 * xy1, 0) / nullif(yy, 0) * n / nullif(n - 1, 0) END AS r1, CASE WHEN b2 IS NOT NULL THEN 1 - greatest(yy - b2 * xy2, 0) / nullif(yy, 0) * n / nullif(n - 1, 0) END AS r2,
     CASE WHEN b3 IS NOT NULL THEN 1 - greatest(yy - y * y / n - b3 * (xy3 - x3 * y / n), 0) / nullif(yy - y * y / n, 0) * (n - 1) / nullif(n - 2, 0) END AS r3 FROM f)
, best AS (SELECT *, greatest(r1, r2, r3) AS m FROM a)
"""
#: 97.5% point of Student's t for any n - 1 degrees of freedom.
T_ANY_SQL = "CASE n - 1 " + " ".join(f"WHEN {i + 1} THEN {t}::DOUBLE" for i, t in enumerate(s.T_975)) + f" ELSE {T_SQL.replace('(n-1)', 'nullif(n-1, 0)')} END"


@query(
    "sta01_regression",
    ctes("ingprod") + _REG + """SELECT retailer, department, aisle, n, CAST(CASE WHEN r1 = m THEN 1 WHEN r2 = m THEN 2 WHEN r3 = m THEN 3 END AS INT) AS form,
      round(CASE WHEN r1 = m THEN b1 WHEN r2 = m THEN b2 WHEN r3 = m THEN b3 END, 5) AS slope, round(m, 5) AS adj_r2 FROM best""",
)
def sta01(spark, d):
    fits = rg.position_regression(derived(spark, d, "ingprod"), ["retailer", "department", "aisle"], "pos", "percent0")
    return fits.select("retailer", "department", "aisle", "n", "form", F.round("slope", 5).alias("slope"), F.round("adj_r2", 5).alias("adj_r2"))


@query(
    "sta02_power_only",
    ctes("ingprod") + _REG + "SELECT retailer, department, aisle, n, CASE WHEN r1 IS NOT NULL THEN round(b1, 5) END AS slope, coalesce(r1 > 0.5 AND abs(b1) > (" + T_ANY_SQL + """) * sqrt(greatest(yy - b1 * xy1, 0) / nullif(n - 1, 0) / nullif(xx1, 0)) AND seen * 1.0 / last >= 0.5 AND last > 5, false) AS accepted FROM a""",
)
def sta02(spark, d):
    fits = rg.position_regression(
        derived(spark, d, "ingprod"), ["retailer", "department", "aisle"], "pos", "percent0", forms=(1,), min_adj_r2=0.5, strict_last=True,
    )
    return fits.select("retailer", "department", "aisle", "n", F.round("slope", 5).alias("slope"), "accepted")


@query(
    "agg20_simple_regression",
    ctes("ingprod") + "SELECT aisle, round(regr_slope(percent0, CAST(pos AS DOUBLE)), 5) AS slope, round(regr_intercept(percent0, CAST(pos AS DOUBLE)), 5) AS intercept, round(regr_r2(percent0, CAST(pos AS DOUBLE)), 5) AS r2 FROM ingprod GROUP BY 1",
)
def agg20(spark, d):
    p = F.col("pos").cast("double")
    return derived(spark, d, "ingprod").groupBy("aisle").agg(
        F.round(F.regr_slope("percent0", p), 5).alias("slope"), F.round(F.regr_intercept("percent0", p), 5).alias("intercept"), F.round(F.regr_r2("percent0", p), 5).alias("r2")
    )


@query(
    "mth01_math",
    "SELECT p_partkey, round(abs(p_size - 25) + ln(p_size + 1) + log2(p_size + 2) + exp(p_size / 100.0) + pow(p_size, 1.5) + sqrt(p_size), 6) AS x, round_even(CAST(p_size AS DOUBLE) * 0.5::DOUBLE, 0) AS half_even FROM part",
)
def mth01(spark, d):
    z = F.col("p_size")
    x = F.abs(z - 25) + F.ln(z + 1) + F.log2(z + 2) + F.exp(z / F.lit(100.0)) + F.pow(z, F.lit(1.5)) + F.sqrt(z)
    return derived(spark, d, "part").select("p_partkey", F.round(x, 6).alias("x"), F.bround(z * F.lit(0.5)).alias("half_even"))


@query(
    "arr01_arrays",
    "SELECT vec_id, round(list_min(embedding)::DOUBLE, 6) AS smallest, CAST(list_position(embedding, list_min(embedding)) AS BIGINT) AS place, len(list_distinct(list_transform(embedding, lambda x: CAST(round(x::DOUBLE, 1) * 10 AS INT)))) AS tenths FROM embeddings",
)
def arr01(spark, d):
    e = F.col("embedding")
    return derived(spark, d, "embeddings").select(
        "vec_id", F.round(F.array_min(e).cast("double"), 6).alias("smallest"), F.array_position(e, F.array_min(e)).alias("place"),
        F.size(F.array_distinct(F.transform(e, lambda x: (F.round(x.cast("double"), 1) * 10).cast("int")))).cast("bigint").alias("tenths"),
    )
