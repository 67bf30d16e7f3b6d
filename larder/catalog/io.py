"""Source and sink queries: data is written to the shared folder, read back and compared with the tables."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from larder.catalog.registry import query
from larder.fixtures import derived
from larder.sources import dims, scans, sinks
from larder.sources.tables import SCHEMAS
from larder.session import scratch_path

_PART = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"


@query("src01_csv", _PART)
def src01(spark, d):
    path = scratch_path(spark, "part")
    sinks.write_csv(derived(spark, d, "part"), path)
    return scans.read_csv(spark, path, SCHEMAS["part"])


@query("src02_tsv_bad_lines", "SELECT p_partkey, p_size FROM part WHERE p_partkey % 10 <> 0")
def src02(spark, d):
    path = scratch_path(spark, "tsv")
    extra = F.when(F.col("p_partkey") % 10 == 0, F.lit("\ttoo\tmany")).otherwise("")
    row = F.concat(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("string")), extra)
    lines = derived(spark, d, "part").select(row.alias("value"))
    lines.union(spark.createDataFrame([("id\tname\tsize",)], "value string")).write.text(path)
    out = scans.read_tsv(spark, path, ["id", "name", "size"], {"id": "bigint", "size": "int"})
    return out.select(F.col("id").alias("p_partkey"), F.col("size").alias("p_size"))


@query("src03_encoding", "SELECT doc_id, regexp_replace(text, '[^a-zA-Zéèêçà ]', '', 'g') AS text FROM documents")
def src03(spark, d):
    path = scratch_path(spark, "latin1")
    text = F.regexp_replace("text", "[^a-zA-Zéèêçà ]", "")
    sinks.write_csv(derived(spark, d, "documents").select("doc_id", F.concat(F.lit("|"), text, F.lit("|")).alias("text")), path, "ISO-8859-1")
    out = scans.read_csv(spark, path, "doc_id bigint, text string", "ISO-8859-1")
    return out.select("doc_id", F.expr("substring(text, 2, length(text) - 2)").alias("text"))


@query(
    "src04_versions",
    "SELECT p_partkey AS product_id, p_name AS product_name, CASE WHEN p_partkey % 2 = 0 THEN 2019 ELSE 2022 END AS extract_year FROM part",
)
def src04(spark, d):
    p = derived(spark, d, "part")
    new = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("uid"), F.col("p_name").alias("title"))
    return scans.read_versions([
        (p.where("p_partkey % 2 = 0"), {"p_partkey": "product_id", "p_name": "product_name"}, 2019), (new, {"uid": "product_id", "title": "product_name"}, 2022),
    ])


@query("src05_folder", "SELECT p_partkey, p_type AS category FROM part")
def src05(spark, d):
    paths = []
    for kind in ("SMALL", "PROMO", "LARGE", "MEDIUM", "ECONOMY", "STANDARD"):
        path = scratch_path(spark, f"kind_{kind}_")
        sinks.write_csv(derived(spark, d, "part").where(F.col("p_type") == kind).select("p_partkey", "p_name"), path)
        paths.append(path)
    return scans.read_folder(spark, paths, "p_partkey bigint, p_name string", "kind_([A-Z]+)_").select("p_partkey", "category")


@query("src06_label_map", "SELECT event_id, event_type AS label, unnest(['a' || user_id, 'b']) AS name FROM events")
def src06(spark, d):
    e = derived(spark, d, "events")
    doc = F.concat(F.lit('{"'), "event_type", F.lit('": ["a'), F.col("user_id").cast("string"), F.lit('", "b"]}'))
    return scans.label_map(e.select("event_id", doc.alias("doc")), "doc", ["event_id"])


@query("src07_vectors", "SELECT doc_id, len(embedding) AS size, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM documents JOIN embeddings ON vec_id = doc_id")
def src07(spark, d):
    v = derived(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    out = scans.with_vectors(derived(spark, d, "documents").select("doc_id"), v, "doc_id")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("doc_id", F.size("embedding").cast("bigint").alias("size"), F.round(total, 4).alias("total"))


@query(
    "src08_inline_dimension",
    "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'Minor' WHEN 'PROMO' THEN 'Minor' WHEN 'LARGE' THEN 'Major' END AS pool FROM part WHERE p_type IN ('SMALL', 'PROMO', 'LARGE')",
)
def src08(spark, d):
    pool = dims.pairs(spark, {"Minor": ["SMALL", "PROMO"], "Major": ["LARGE"]}, "pool", "p_type")
    return derived(spark, d, "part").join(pool, "p_type").select("p_partkey", "pool")


@query("src09_label_sheet", "SELECT doc_id, quality, toxic FROM labels")
def src09(spark, d):
    path = scratch_path(spark, "labels")
    sinks.write_csv(derived(spark, d, "labels"), path)
    return scans.read_csv(spark, path, SCHEMAS["labels"])


@query("snk01_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def snk01(spark, d):
    path = scratch_path(spark, "customer")
    sinks.write_csv(derived(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return scans.read_csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("snk02_split", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def snk02(spark, d):
    path = scratch_path(spark, "orders")
    sinks.write_split(derived(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path, ["o_orderstatus", "o_orderpriority"])
    return spark.read.schema("o_orderkey bigint, o_orderstatus string, o_orderpriority string").parquet(path)


@query("snk03_resume", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'first run' ELSE 'second run' END AS run FROM orders")
def snk03(spark, d):
    path = scratch_path(spark, "resume")
    orders = derived(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    sinks.write_pending(orders.where("o_orderstatus = 'F'").withColumn("run", F.lit("first run")), path, ["o_orderstatus"])
    sinks.write_pending(orders.withColumn("run", F.lit("second run")), path, ["o_orderstatus"])
    return spark.read.schema("o_orderkey bigint, run string, o_orderstatus string").parquet(path)


@query(
    "snk04_batches",
    "SELECT CAST((row_number() OVER (ORDER BY md5('42|' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1) // 500 AS INT) AS batch, c_custkey FROM customer",
)
def snk04(spark, d):
    path = scratch_path(spark, "batches")
    sinks.write_batches(derived(spark, d, "customer").select("c_custkey"), path, ["c_custkey"])
    return spark.read.schema("c_custkey bigint, batch int").parquet(path)


@query("snk05_model", "SELECT p_partkey, p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS DOUBLE) AS index FROM part")
def snk05(spark, d):
    path = scratch_path(spark, "model")
    p = derived(spark, d, "part").select("p_partkey", "p_type")
    sinks.save_model(Pipeline(stages=[StringIndexer(inputCol="p_type", outputCol="index", stringOrderType="alphabetAsc")]).fit(p), path)
    return sinks.load_model(spark, path).transform(p)


@query("snk06_chunks", "SELECT vec_id, label FROM embeddings")
def snk06(spark, d):
    path = scratch_path(spark, "chunks")
    sinks.write_chunks(derived(spark, d, "embeddings"), path)
    return spark.read.schema(SCHEMAS["embeddings"]).parquet(path).select("vec_id", "label")
