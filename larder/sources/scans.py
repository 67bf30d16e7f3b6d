"""Scans of the product, trade and label files: delimited text, encodings, versions, folders, JSON maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str | list[str], schema: str, encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """Delimited text with a header and an explicit schema; unused columns are pruned from the scan."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", encoding).option("escape", '"').csv(path)


def read_tsv(spark: SparkSession, path: str, header: list[str], columns: dict[str, str]) -> DataFrame:
    """Tab-separated lines; a line with more fields than the header is skipped, one with fewer ends in NULLs.

    Files are split and read in parallel; each may start with the header line.
    """
    lines = spark.read.text(path).where(F.col("value") != "\t".join(header))
    fields = F.split("value", "\t", -1)
    good = lines.where(F.size(fields) <= len(header))
    return good.select(*[F.nullif(F.get(fields, F.lit(header.index(c))), F.lit("")).try_cast(t).alias(c) for c, t in columns.items()])


def read_versions(versions: list[tuple[DataFrame, dict[str, str], int]]) -> DataFrame:
    """Extracts of different years under one set of names, tagged with their year."""
    parts = [df.select(*[F.col(old).alias(new) for old, new in names.items()]).withColumn("extract_year", F.lit(year)) for df, names, year in versions]
    return reduce(DataFrame.unionByName, parts)


def read_folder(spark: SparkSession, paths: list[str], schema: str, pattern: str, name: str = "category") -> DataFrame:
    """Many files as one table; a column tells the part of the file path that ``pattern`` captures."""
    return read_csv(spark, paths, schema).withColumn(name, F.regexp_extract(F.input_file_name(), pattern, 1))


def label_map(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """JSON objects of lists (label to names) as one row per label and name."""
    parsed = df.select(*keys, F.explode(F.from_json(column, "map<string,array<string>>")).alias("label", "names"))
    return parsed.select(*keys, "label", F.explode("names").alias("name"))


def with_vectors(products: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Products with their embedding; products without one drop out."""
    return products.join(vectors, key)


def edited(description: Column, edit: Column) -> Column:
    """The edited description where there is one."""
    return F.coalesce(edit, description)
