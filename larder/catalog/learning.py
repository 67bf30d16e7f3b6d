"""Classification, metrics, language and label queries, and the ingest flow."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from larder.catalog.registry import query
from larder.fixtures import derived
from larder.functions.draws import key_number_sql
from larder.operators import classify as cl
from larder.operators import labels as la
from larder.operators import language as lg
from larder.operators import metrics as me
from larder.operators.ordering import split_flag
from larder.plans import classification, ingest
from larder.session import scratch_path
from larder.sources.scans import edited

_JUDGED = "SELECT d.doc_id, l.quality AS label, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


def _judged(spark, d):
    both = derived(spark, d, "labels").join(derived(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.select("doc_id", F.col("quality").alias("label"), (F.col("n_chars") > 1500).cast("int").alias("pred"))


@query(
    "sta03_metrics",
    f"""WITH j AS ({_JUDGED}), c AS (SELECT sum(CASE WHEN label = 1 AND pred = 1 THEN 1.0::DOUBLE ELSE 0 END) AS tp, sum(CASE WHEN label = 0 AND pred = 0 THEN 1.0::DOUBLE ELSE 0 END) AS tn,
      sum(CASE WHEN label = 0 AND pred = 1 THEN 1.0::DOUBLE ELSE 0 END) AS fp, sum(CASE WHEN label = 1 AND pred = 0 THEN 1.0::DOUBLE ELSE 0 END) AS fn FROM j)
    , m AS (SELECT *, tp + tn + fp + fn AS n, tp / (tp + fn) AS r1, tn / (tn + fp) AS r0, coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tn / nullif(tn + fn, 0), 0) AS p0 FROM c)
    SELECT round((tp + tn) / n, 6) AS accuracy, round((r1 + r0) / 2, 6) AS balanced_accuracy, round((p1 * (tp + fn) + p0 * (tn + fp)) / n, 6) AS precision, round((r1 * (tp + fn) + r0 * (tn + fp)) / n, 6) AS recall,
      round((coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) * (tp + fn) + coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) * (tn + fp)) / n, 6) AS f1,
      round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM m""",
)
def sta03(spark, d):
    m = me.classification_metrics(_judged(spark, d), "label", "pred")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("sta04_class_weights", "SELECT p_type, round((SELECT count(*) FROM part) / CAST((SELECT count(DISTINCT p_type) FROM part) * count(*) AS DOUBLE), 6) AS weight FROM part GROUP BY 1")
def sta04(spark, d):
    return me.class_weights(derived(spark, d, "part"), "p_type").withColumn("weight", F.round("weight", 6))


_PROB = "SELECT p_partkey, p_retailprice / (SELECT max(p_retailprice) FROM part) AS p0, CASE WHEN p_partkey % 3 <> 0 THEN p_size / 50.0::DOUBLE END AS p2 FROM part"


def _prob(spark, d):
    p = derived(spark, d, "part")
    return p.select("p_partkey", (F.col("p_retailprice") / p.agg(F.max("p_retailprice")).scalar()).alias("p0"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") / 50.0).alias("p2"))


@query("sta05_coverage", f"SELECT count(*) AS n, CAST(sum(CASE WHEN p0 > 0.8 AND (p2 IS NULL OR p2 > 0.8) THEN 1 ELSE 0 END) AS BIGINT) AS confident, round(avg(CASE WHEN p0 > 0.8 AND (p2 IS NULL OR p2 > 0.8) THEN 1.0 ELSE 0 END), 6) AS share FROM ({_PROB})")
def sta05(spark, d):
    return me.coverage(_prob(spark, d), "p0", "p2").withColumn("share", F.round("share", 6))


def _two_models(spark, d):
    p = derived(spark, d, "part")
    a = p.select("p_partkey", F.col("p_type").alias("level0"), F.col("p_brand").alias("level2"), (F.col("p_size") / 50.0).alias("p0"))
    other = F.when(F.col("p_partkey") % 4 == 0, "OTHER").otherwise(F.col("p_type"))
    sub = F.when(F.col("p_partkey") % 3 == 0, "Brand#0").otherwise(F.col("p_brand"))
    return a, p.select("p_partkey", other.alias("level0"), sub.alias("level2"), (F.col("p_size") / 100.0).alias("p0"))


_AGREE = "SELECT p_partkey, p_partkey % 4 <> 0 AS agree0, p_partkey % 3 <> 0 OR p_brand = 'Brand#0' AS agree2, p_size / 50.0::DOUBLE AS p0, p_size / 100.0::DOUBLE AS p0_b FROM part"


@query("sta06_agreement", f"SELECT agree0, agree2, count(*) AS n, round(avg(p0), 6) AS p0, round(avg(p0_b), 6) AS p0_b FROM ({_AGREE}) GROUP BY 1, 2")
def sta06(spark, d):
    return me.agreement(*_two_models(spark, d), "p_partkey").withColumn("p0", F.round("p0", 6)).withColumn("p0_b", F.round("p0_b", 6))


@query("jon16_model_vs_model", f"SELECT p_partkey, agree0, agree2 FROM ({_AGREE})")
def jon16(spark, d):
    a, b = _two_models(spark, d)
    both = a.join(b.withColumnsRenamed({c: f"{c}_b" for c in b.columns if c != "p_partkey"}), "p_partkey")
    return both.select("p_partkey", (F.col("level0") == F.col("level0_b")).alias("agree0"), (F.col("level2") == F.col("level2_b")).alias("agree2"))


@query(
    "sta07_cosine",
    """WITH u AS (SELECT label, i, avg(v::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
    c AS (SELECT label, list(m ORDER BY i) AS centre FROM u GROUP BY 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], centre::DOUBLE[]), 5) AS similarity FROM embeddings JOIN c USING (label)""",
)
def sta07(spark, d):
    e = derived(spark, d, "embeddings")
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))).alias("centre")
    out = e.join(e.groupBy("label").agg(mean), "label")
    return out.select("vec_id", F.round(me.cosine(F.col("embedding"), F.col("centre")), 5).alias("similarity"))


def _classes(spark, d):
    e = derived(spark, d, "embeddings")
    return e.select("vec_id", "embedding", (F.col("label") % 3).cast("string").alias("top"), F.col("label").cast("string").alias("low"))


def _parts(spark, d):
    """Rows to learn from, and the rows held out, which are scored."""
    df = _classes(spark, d).withColumn("part", split_flag(["vec_id"]))
    return df.where("part = 'train'").drop("part"), df.where("part = 'test'").drop("part")


@query("sta08_pca")
def sta08(spark, d):
    out, k = cl.principal_components(derived(spark, d, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", F.size("pca").alias("k"), F.round(F.get("pca", F.lit(0)), 5).alias("first"))


@query("cls01_forest")
def cls01(spark, d):
    train, test = map(cl.vectors, _parts(spark, d))
    return cl.predict(cl.fit_forest(train, "top", trees=20, depth=8), test, "pred").select("vec_id", "top", "pred", "pred_prob")


@query("cls02_network")
def cls02(spark, d):
    train, test = map(cl.vectors, _parts(spark, d))
    return cl.predict(cl.fit_network(train, "top", [16], 30), test, "pred").select("vec_id", "top", "pred", "pred_prob")


@query("cls03_hierarchical")
def cls03(spark, d):
    train, test = _parts(spark, d)
    return cl.hierarchical(train, test, "top", "low", ["2"]).select("vec_id", "top", "low", "top_pred", "low_pred", "top_pred_prob")


@query("cls16_stored_models")
def cls16(spark, d):
    """Stored models of each class read back, gates applied."""
    train, test = _parts(spark, d)
    train = train.select("vec_id", "embedding", F.col("top").alias("parent"), F.concat(F.lit("main "), F.col("low").cast("int") % 2).alias("main"), F.col("low").alias("sub"))
    path = scratch_path(spark, "models")
    classification.store_models(train, path, ["2"])
    return classification.predictions(test.select("vec_id", "embedding"), train, path).drop("embedding")


@query("cls05_discriminant")
def cls05(spark, d):
    train, test = _parts(spark, d)
    return cl.Discriminant.fit(train, "low").predict(test, "pred").select("vec_id", "low", "pred", "pred_prob")


@query("cls06_per_level")
def cls06(spark, d):
    train, test = _parts(spark, d)
    return cl.per_level(train, test, ["top", "low"]).select("vec_id", "top", "low", "top_pred", "low_pred")


@query("cls07_bake_off")
def cls07(spark, d):
    return cl.bake_off(cl.vectors(_classes(spark, d)), "vec_id", "top", trees=10)


_SPLIT = "CAST('0x' || substr(md5('42|' || CAST(vec_id AS VARCHAR)), 1, 7) AS BIGINT) / 268435456.0 < 0.8"


@query(
    "cls07_neighbours",
    f"""WITH x AS (SELECT vec_id, CAST(label % 3 AS VARCHAR) AS l, embedding::DOUBLE[] AS e, {_SPLIT} AS train FROM embeddings),
    n AS (SELECT q.vec_id, t.l, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(power(list_distance(q.e, t.e), 2), 12), t.vec_id) AS r FROM x q JOIN x t ON t.train AND NOT q.train), v AS (SELECT vec_id, l, count(*) AS c FROM n WHERE r <= 5 GROUP BY 1, 2)
    SELECT vec_id, l AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, l) AS k FROM v) WHERE k = 1""",
)
def cls07_neighbours(spark, d):
    return cl.nearest(*_parts(spark, d), "vec_id", "top", rows_per_block=1000)


@query("cls08_grid_search")
def cls08(spark, d):
    grid = [{"trees": 5, "depth": 4}, {"trees": 10, "depth": 6}]
    return cl.grid_search(cl.vectors(_classes(spark, d)), "vec_id", "top", grid)


_CENTRES = f"""WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, embedding::DOUBLE[] AS v, {_SPLIT} AS train FROM embeddings),
  u AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e WHERE train) GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS centre FROM u GROUP BY 1),
  s AS (SELECT vec_id, c.label AS class, list_cosine_similarity(v, centre) AS score FROM e, c WHERE NOT train)"""


def _centre_scores(spark, d):
    train, test = _parts(spark, d)
    return cl.centre_scores(train, test, "low")


@query("cls09_confidence", _CENTRES + " SELECT vec_id, round(1 / sum(exp(score - top)), 6) AS confidence FROM (SELECT *, max(score) OVER (PARTITION BY vec_id) AS top FROM s) GROUP BY 1")
def cls09(spark, d):
    return _centre_scores(spark, d).select("vec_id", F.round(cl.confidence(F.col("scores.score")), 6).alias("confidence"))


@query("cls15_top_class", _CENTRES + " SELECT vec_id, arg_max(class, score) AS best FROM s GROUP BY 1")
def cls15(spark, d):
    scored = _centre_scores(spark, d)
    names = [r["class"] for r in scored.select("scores").first()["scores"]]
    return scored.select("vec_id", cl.top_class(F.col("scores.score"), names).alias("best"))


@query(
    "cls10_text_vectors",
    f"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s')) AS word FROM documents), n AS (SELECT count(*) AS docs FROM documents),
      tf AS (SELECT doc_id, {key_number_sql('word')} % 256 AS bucket, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT bucket, count(*) AS df FROM tf GROUP BY 1)
    SELECT doc_id, CAST(bucket AS INT) AS bucket, round(tf * ln((docs + 1.0) / (df + 1.0)), 9) AS weight FROM tf JOIN df USING (bucket), n WHERE df < docs""",
)
def cls10(spark, d):
    out = cl.text_vectors(derived(spark, d, "documents").select("doc_id", "text"), "text", 256)
    filled = F.transform(vector_to_array("features"), lambda v, i: F.struct(i.cast("int").alias("bucket"), F.round(v, 9).alias("weight")))
    return out.select("doc_id", F.explode(F.filter(filled, lambda x: x["weight"] != 0)).alias("x")).select("doc_id", "x.*")


_WORDS = """WITH w AS (SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2),
  t AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS total, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM c), p AS (SELECT lang, word, n / CAST(total AS DOUBLE) AS share FROM t),
  s AS (SELECT doc_id, p.lang, round(sum(share), 9) AS score FROM w JOIN p ON p.word = w.word GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS k FROM s)"""


@query("txt29_language", _WORDS + " SELECT d.doc_id, CASE WHEN length(trim(d.text)) > 1 AND b.lang IS NOT NULL THEN b.lang ELSE 'und' END AS language FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND k = 1")
def txt29(spark, d):
    t = derived(spark, d, "documents").select("doc_id", "text", "lang")
    return lg.detect_language(t, "text", "doc_id", lg.word_profile(t, "text", "lang")).select("doc_id", "language")


_GRAM_SQL = f"""WITH t AS (SELECT doc_id, lang, text, ' ' || lower(text) || ' ' AS x FROM documents), c AS (SELECT doc_id, lang, unicode(x[i]) AS a, unicode(x[i + 1]) AS b, unicode(x[i + 2]) AS c, i, length(x) AS n FROM (SELECT *, unnest(range(1, length(x) + 1)) AS i FROM t)),
  g AS (SELECT doc_id, lang, unnest(CASE WHEN i + 2 <= n THEN [a, a * {lg.FACTOR} + b, (a * {lg.FACTOR} + b) * {lg.FACTOR}::BIGINT + c] WHEN i + 1 <= n THEN [a, a * {lg.FACTOR} + b] ELSE [a] END) % {lg.BUCKETS} AS bucket FROM c),
  d AS (SELECT doc_id, lang, bucket, count(*) AS n FROM g GROUP BY ALL), w AS (SELECT lang, bucket, sum(n) AS n FROM d GROUP BY ALL), total AS (SELECT lang, ln(sum(n) + {lg.BUCKETS}) AS whole FROM w GROUP BY 1),
  s AS (SELECT d.doc_id, l.lang, sum(d.n * (ln(1 + coalesce(w.n, 0)) - l.whole)) AS score FROM d CROSS JOIN total l LEFT JOIN w ON w.lang = l.lang AND w.bucket = d.bucket GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS k FROM s)
  SELECT t.doc_id, CASE WHEN length(trim(t.text)) > 1 THEN b.lang ELSE 'und' END AS language FROM t LEFT JOIN b ON b.doc_id = t.doc_id AND k = 1"""


@query("txt29_language_grams", _GRAM_SQL)
def txt29_grams(spark, d):
    t = derived(spark, d, "documents").select("doc_id", "text", "lang")
    return lg.detect_by_grams(t, "text", lg.gram_model(t, "text", "lang")).select("doc_id", "language")


@query(
    "txt30_translated",
    "WITH c AS (SELECT text, min(doc_id) % 4 AS k FROM documents GROUP BY 1) SELECT d.doc_id, CASE c.k WHEN 0 THEN d.text WHEN 1 THEN '' WHEN 2 THEN lower(d.text) ELSE d.text END AS english FROM documents d JOIN c ON c.text = d.text",
)
def txt30(spark, d):
    t = derived(spark, d, "documents").select("doc_id", "text")
    k = F.col("k")
    cache = t.groupBy("text").agg((F.min("doc_id") % 4).alias("k")).where("k <> 3")
    cache = cache.select("text", F.when(k == 0, "Error: too many requests").when(k == 1, "na").otherwise(F.lower("text")).alias("translation"))
    return lg.translated(t, "text", cache, "english").select("doc_id", "english")


@query(
    "cls11_self_labels",
    "SELECT p_partkey AS product_id, p_brand AS sub FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'predicted' FROM part WHERE p_partkey % 3 <> 0 AND p_size / 50.0 > 0.5",
)
def cls11(spark, d):
    p = derived(spark, d, "part")
    labels = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("sub"))
    predictions = p.select(F.col("p_partkey").alias("product_id"), F.lit("predicted").alias("sub"), (F.col("p_size") / 50.0).alias("similarity"))
    return la.self_labels(labels, predictions)


@query(
    "cls12_assembled_labels",
    """WITH s AS (SELECT p_partkey AS product_id, p_type AS parent, p_brand AS main, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS sub FROM part WHERE p_partkey % 2 = 0
      UNION ALL SELECT p_partkey, p_type, 'second', 'second' FROM part WHERE p_partkey % 2 = 1), t AS (SELECT s.*, upper(p_name) AS name, p_type AS ingredients FROM s JOIN part ON p_partkey = product_id)
    SELECT product_id, parent, main, sub FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), lower(ingredients) ORDER BY CASE WHEN sub IS NULL THEN 1 ELSE 0 END, product_id) AS k FROM t) WHERE k = 1""",
)
def cls12(spark, d):
    p = derived(spark, d, "part").withColumn("product_id", F.col("p_partkey"))
    first = p.where("p_partkey % 2 = 0").select("product_id", F.col("p_type").alias("parent"), F.col("p_brand").alias("main"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("sub"))
    second = p.select("product_id", F.col("p_type").alias("parent"), F.lit("second").alias("main"), F.lit("second").alias("sub"))
    texts = p.select("product_id", F.upper("p_name").alias("name"), F.col("p_type").alias("ingredients"))
    return la.assembled_labels([first, second], texts).select(*la.LABEL)


@query("cls13_edited", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 5 = 0 THEN p_brand END, p_type) AS description FROM part")
def cls13(spark, d):
    return derived(spark, d, "part").select("p_partkey", edited(F.col("p_type"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand"))).alias("description"))


@query("cls14_label_score", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END END AS score FROM part")
def cls14(spark, d):
    label = F.when(F.col("p_partkey") % 3 != 0, F.col("p_type"))
    return derived(spark, d, "part").select("p_partkey", me.label_score(label, F.lit("SMALL")).alias("score"))


@query(
    "ing01_open_products",
    _WORDS + """, x AS (SELECT doc_id, 'Product ' || source AS product_name, text AS ingredients_text, lang, unnest(string_split(lang || ',' || source, ',')) AS country FROM documents)
    , f AS (SELECT country FROM x GROUP BY 1 HAVING count(*) > 12), y AS (SELECT DISTINCT product_name, ingredients_text, country FROM x WHERE country IN (SELECT country FROM f))
    , l AS (SELECT text, min(CASE WHEN length(trim(text)) > 1 AND b.lang IS NOT NULL THEN b.lang ELSE 'und' END) AS lang FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND k = 1 GROUP BY 1)
    SELECT country, CASE WHEN l.lang = 'en' THEN 'eng' ELSE 'other' END AS route, count(*) AS n FROM y JOIN l ON l.text = y.ingredients_text GROUP BY 1, 2""",
)
def ing01(spark, d):
    t = derived(spark, d, "documents")
    raw = t.select(F.concat(F.lit("Product "), "source").alias("product_name"), F.col("text").alias("ingredients_text"), F.concat_ws(",", "lang", "source").alias("countries"))
    out = ingest.open_products(raw, lg.word_profile(t, "text", "lang"), 12)
    return out.groupBy("country", F.when(F.col("route") == "eng", "eng").otherwise("other").alias("route")).agg(F.count("*").alias("n"))


@query("ing02_product_table")
def ing02(spark, d):
    p = derived(spark, d, "prod").join(derived(spark, d, "dirty"), "id").join(derived(spark, d, "labelled").select("id", "energy_per_100", "salt_per_100", F.col("serving_text").alias("serving_size")), "id", "left")
    p = p.withColumnRenamed("id", "product_id").withColumn("store", F.col("retailer"))
    shop = p.where("product_id % 2 = 0").drop("country").withColumn("serving_size_unit", F.lit("g")).withColumn("serving_size_value", F.lit(30.0))
    return ingest.product_table(p.where("product_id % 2 = 1"), shop).select("product_id", "database", "country_group", "ingredients_text", "energy_per_100_value", "salt_per_100_value", "serving_size_unit")
